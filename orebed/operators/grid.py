"""Regular grids: cells with the flat index (ix * ny + iy) * nz + iz."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Grid:
    origin: tuple[float, float, float]
    step: tuple[float, float, float]
    shape: tuple[int, int, int]

    @property
    def volume(self) -> float:
        return math.prod(self.step)

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells with their centres, made where they are used."""
        out = cells(spark, *self.shape)
        return out.withColumns({a: F.lit(o) + F.col(f"i{a}") * s for a, o, s in zip("xyz", self.origin, self.step, strict=True)})


def cells(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    c = F.col("id")
    return spark.range(nx * ny * nz).select(c.alias("cell_id"), F.floor(c / (ny * nz)).cast("long").alias("ix"), (F.floor(c / nz) % ny).cast("long").alias("iy"), (c % nz).alias("iz"))


def around(df: DataFrame, step: tuple[float, float, float], buffer: tuple[float, float, float] = (50.0, 50.0, 10.0)) -> Grid:
    """A grid over the data's bounds and a buffer, its origin snapped down to the step."""
    e = df.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    origin = tuple(math.floor((e[f"lo{a}"] - b) / s) * s for a, s, b in zip("xyz", step, buffer, strict=True))
    shape = tuple(max(1, math.ceil((e[f"hi{a}"] + b - o) / s) + 1) for a, s, b, o in zip("xyz", step, buffer, origin, strict=True))
    return Grid(origin, step, shape)


def factors(fine: Grid, coarse: Grid) -> tuple[int, int, int]:
    """Whole numbers of fine cells in a coarse one; grids that don't nest raise."""
    out = []
    for k in range(3):
        f = round(coarse.step[k] / fine.step[k])
        if abs(f * fine.step[k] - coarse.step[k]) > 1e-9 or abs(fine.origin[k] - coarse.origin[k]) > 1e-9 or fine.shape[k] != f * coarse.shape[k]:
            raise ValueError("the grids don't nest")
        out.append(f)
    return tuple(out)
