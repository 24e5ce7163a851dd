"""Summaries over realisations of a grid, held as long rows (real_id, cell_id, ix, iy, iz, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import entropy, half_width, ratio
from . import order

CELL = ("cell_id", "ix", "iy", "iz")


def _percentiles(value: Column | str, marks: dict[str, float]) -> list[Column]:
    return [F.percentile(value, F.lit(p)).alias(n) for n, p in marks.items()]


def cell_percentiles(reals: DataFrame, marks: dict[str, float] | None = None, missing_spreads: bool = True) -> DataFrame:
    """Exact percentiles of each cell over its realisations; one group holds a value per realisation.
    A missing value makes a cell's percentiles missing (or is left out)."""
    marks = marks or {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = reals.groupBy(*CELL).agg(*_percentiles("value", marks), F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("_missing"))
    if missing_spreads:
        out = out.select(*CELL, "n", *[F.when(F.col("_missing") == 0, F.col(m)).alias(m) for m in marks])
    return out.drop("_missing")


def exceedance(reals: DataFrame, cutoff: float) -> DataFrame:
    """Share of each cell's values strictly above the cutoff."""
    return reals.groupBy(*CELL).agg((F.count_if(F.col("value") > cutoff) / F.greatest(F.count("value"), F.lit(1))).alias("probability"))


def cutoff_curve(reals: DataFrame, cutoffs: list[float], volume: float, density: float) -> DataFrame:
    """By cutoff and realisation: blocks at or above it, tonnage, mean grade, contained; 0 when none is.

    All cutoffs are conditional sums of one pass and one shuffle by realisation."""
    sums = []
    for k, c in enumerate(cutoffs):
        at = F.col("value") >= c
        sums += [F.count_if(at).alias(f"n{k}"), F.coalesce(F.avg(F.when(at, F.col("value"))), F.lit(0.0)).alias(f"g{k}")]
    wide = reals.groupBy("real_id").agg(*sums)
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"n{k}").alias("blocks"), F.col(f"g{k}").alias("avg_grade")) for k, c in enumerate(cutoffs)])
    long = wide.select("real_id", F.explode(rows).alias("r")).select("real_id", "r.*")
    long = long.withColumn("tonnage", F.col("blocks") * (volume * density))
    return long.withColumn("contained", F.col("tonnage") * F.col("avg_grade") / 100)


def curve_summary(curve: DataFrame) -> DataFrame:
    """Percentiles and means over realisations for each cutoff."""
    marks = {"p05": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95}
    out = []
    for name, column in (("tonnage", "tonnage"), ("grade", "avg_grade"), ("contained", "contained")):
        out += _percentiles(column, {f"{name}_{m}": p for m, p in marks.items()}) + [F.avg(column).alias(f"{name}_mean")]
    return curve.groupBy("cutoff").agg(*out, F.count_if(F.col("blocks") > 0).alias("nonzero_count"))


def curve_is_sane(summary: DataFrame) -> DataFrame:
    """The summary, once checked while it is read: the median tonnage never grows with the cutoff and
    the mean grade above a cutoff reaches it."""
    w = Window.orderBy("cutoff")
    x = summary.withColumn("_before", F.lag("tonnage_p50").over(w))
    fine = F.coalesce(F.col("tonnage_p50") <= F.col("_before") + 1e-6, F.lit(True)) & ((F.col("grade_p50") >= F.col("cutoff") - 1e-6) | (F.col("tonnage_p50") == 0))
    return x.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("cutoff curve is not monotone")).cast("boolean"))).drop("_before")


def interval_benchmark(summary: DataFrame, target: float) -> DataFrame:
    """Relative half width of the 90 percent interval of tonnage and grade, and the cutoff nearest to the target."""
    x = summary.select("cutoff", half_width(F.col("tonnage_p05"), F.col("tonnage_p50"), F.col("tonnage_p95")).alias("tonnage_half_width"), half_width(F.col("grade_p05"), F.col("grade_p50"), F.col("grade_p95")).alias("grade_half_width"))
    nearest = x.agg(F.min_by("cutoff", F.struct(F.abs(F.col("cutoff") - target), "cutoff")).alias("nearest"))
    return x.crossJoin(F.broadcast(nearest)).withColumn("is_target", F.col("cutoff") == F.col("nearest")).drop("nearest")


def regularise(reals: DataFrame, fx: int, fy: int, fz: int) -> DataFrame:
    """Plain means of fx * fy * fz cells; a missing value makes its block missing."""
    keys = [F.floor(F.col(a) / f).cast("long").alias(f"b{a}") for a, f in (("ix", fx), ("iy", fy), ("iz", fz))]
    return reals.groupBy("real_id", *keys).agg(F.when(F.count_if(F.col("value").isNull()) == 0, F.avg("value")).alias("value"))


def swath(reals: DataFrame, axis: str) -> DataFrame:
    """Percentiles, over realisations, of the mean of each slice."""
    return reals.groupBy("real_id", axis).agg(F.avg("value").alias("m")).groupBy(axis).agg(*_percentiles("m", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def swath_cover(cells: DataFrame, data: DataFrame, axis: str) -> DataFrame:
    """Percent of slices whose data mean lies within the mean P10 to P90 of the cells, and how many slices there are.
    ``cells``: axis, p10, p90; ``data``: axis, value."""
    lines = cells.groupBy(axis).agg(F.avg("p10").alias("lo"), F.avg("p90").alias("hi"))
    means = data.groupBy(axis).agg(F.avg("value").alias("m"))
    return lines.join(means, axis).agg((100 * F.avg(F.col("m").between(F.col("lo"), F.col("hi")).cast("double"))).alias("cover_pct"), F.count(F.lit(1)).alias("slices"))


def share_above(reals: DataFrame, cutoff: float) -> DataFrame:
    """Percentiles over realisations of the share of cells at or above the cutoff."""
    return reals.groupBy("real_id").agg(F.avg((F.col("value") >= cutoff).cast("double")).alias("s")).agg(*_percentiles("s", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


def category_shares(cats: DataFrame, n: int) -> DataFrame:
    """For each cell the share of realisations in each category, the entropy, and the likeliest share."""
    total = F.count(F.lit(1))
    out = cats.groupBy(*CELL).agg(*[(F.count_if(F.col("category_id") == k) / total).alias(f"s{k}") for k in range(n)])
    shares = [F.col(f"s{k}") for k in range(n)]
    return out.withColumn("entropy", entropy(shares)).withColumn("max_share", F.greatest(*shares))


def entropy_summary(shares: DataFrame, ore: list[int]) -> DataFrame:
    p = sum((F.col(f"s{k}") for k in ore[1:]), F.col(f"s{ore[0]}"))
    one = shares.agg(F.avg("entropy").alias("mean_entropy"), F.avg((F.col("entropy") >= 0.5).cast("double")).alias("share_uncertain"), F.avg((p >= 0.1).cast("double")).alias("share_ore"))
    return one.crossJoin(F.broadcast(order.quantile_row(shares, "entropy", {"p90_entropy": 0.9}))).select("mean_entropy", "p90_entropy", "share_uncertain", "share_ore")


def thickness(cats: DataFrame, ore: list[int], dz: float) -> DataFrame:
    """Percentiles over realisations of a column's ore thickness, the chance of any, and the relative spread."""
    one = cats.groupBy("real_id", "ix", "iy").agg((F.count_if(F.col("category_id").isin(ore)) * dz).alias("t"))
    out = one.groupBy("ix", "iy").agg(*_percentiles("t", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), F.avg((F.col("t") > 0).cast("double")).alias("present"))
    return out.withColumn("aperture_pct", 100 * ratio(F.col("p90") - F.col("p10"), F.col("p50")))


def collapse(cells: DataFrame, value: str, share: str, least: float = 0.1) -> DataFrame:
    """Mean over z of the cells likely enough, or of all where none is."""
    return cells.groupBy("ix", "iy").agg(F.coalesce(F.avg(F.when(F.col(share) >= least, F.col(value))), F.avg(value)).alias(value))


def confidence_gradient(cells: DataFrame) -> DataFrame:
    """Spread and aperture of cells (p10, p50, p90), the largest over z, and the share of the overall median."""
    x = cells.withColumn("spread", F.col("p90") - F.col("p10")).withColumn("aperture_pct", 100 * ratio(F.col("p90") - F.col("p10"), F.col("p50")))
    top = x.groupBy("ix", "iy").agg(F.max("spread").alias("max_spread"), F.max("aperture_pct").alias("max_aperture_pct"))
    middle = order.quantile_row(x, "spread", {"median_spread": 0.5})
    return top.crossJoin(F.broadcast(middle)).withColumn("relative", F.col("max_spread") / F.col("median_spread")).drop("median_spread")


def hotspots(shares: DataFrame, ore: list[int], n: int, least: float = 0.1) -> DataFrame:
    """The n cells of highest entropy among those likely enough to be ore."""
    p = sum((F.col(f"s{k}") for k in ore[1:]), F.col(f"s{ore[0]}"))
    return shares.withColumn("ore", p).filter(F.col("ore") >= least).orderBy(F.desc("entropy"), F.desc("ore"), "cell_id").limit(n)


def largest(cells: DataFrame, by: str, n: int, ties: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """The n rows where ``by`` is largest; rows without it are left out, equal ones go by ``ties``."""
    return cells.filter(F.col(by).isNotNull()).orderBy(F.desc(by), *ties).limit(n)


def evenly_chosen(n: int, wanted: int) -> list[int]:
    """Numbers of ``wanted`` realisations spread evenly from the first to the last of n, cut to whole numbers."""
    wanted = max(1, min(wanted, n))
    return [int(k * (n - 1) / (wanted - 1)) if wanted > 1 else 0 for k in range(wanted)]


def convergence_by_cell(reals: DataFrame, checkpoints: list[int], cutoff: float) -> DataFrame:
    """For each n, how cells' chance of the cutoff, mean, P10, P50, P90 and variance over the first n
    realisations compare with those over all: mean absolute difference and correlation, a row each."""
    last = max(checkpoints)
    some = reals.select(*CELL, "value", F.explode(F.array(*[F.when(F.col("real_id") < n, F.lit(n)) for n in checkpoints])).alias("n_real")).filter("n_real IS NOT NULL")
    maps = some.groupBy("n_real", *CELL).agg(F.avg((F.col("value") > cutoff).cast("double")).alias("chance"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), *_percentiles("value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}))
    names = ["chance", "mean", "variance", "p10", "p50", "p90"]
    long = maps.unpivot(["n_real", *CELL], names, "map", "value")
    full = long.filter(F.col("n_real") == last).select(*CELL, "map", F.col("value").alias("full"))
    both = long.join(full, [*CELL, "map"])
    return both.groupBy("n_real", "map").agg(F.avg(F.abs(F.col("value") - F.col("full"))).alias("mae"), F.corr("value", "full").alias("r"))


def convergence(reals: DataFrame, checkpoints: list[int]) -> DataFrame:
    """Mean and spread of the overall mean over the first n realisations, for each n."""
    each = reals.groupBy("real_id").agg(F.avg("value").alias("m"))
    return each.select("m", F.explode(F.array(*[F.when(F.col("real_id") < n, F.lit(n)) for n in checkpoints])).alias("n_real")).filter("n_real IS NOT NULL").groupBy("n_real").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("spread"), F.count(F.lit(1)).alias("n"))


def draw_category(shares: Column, u: Column) -> Column:
    """Index of the first cumulative share that a uniform number does not exceed, never beyond the last."""
    cumulative = F.transform(F.sequence(F.lit(1), F.size(shares)), lambda k: F.aggregate(F.slice(shares, 1, k), F.lit(0.0), lambda a, b: a + b))
    return F.least(F.size(F.filter(cumulative, lambda c: u > c)), F.size(shares) - 1)
