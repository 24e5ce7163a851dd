"""Checks of drillhole tables: one row for each rule, with the number of rows at fault."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bad(when: Column) -> Column:
    return F.count_if(when)


def _unpivoted(one: DataFrame, table: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in one.columns])
    return one.select(F.explode(pairs).alias("r")).select(F.lit(table).alias("table_name"), "r.rule", "r.n")


def check_collars(df: DataFrame) -> DataFrame:
    one = df.agg((F.count(F.lit(1)) - F.count_distinct("hole_id")).alias("duplicate_ids"), _bad(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("no_place"), _bad(F.col("hole_id").isNull()).alias("no_id"))
    return _unpivoted(one, "collar")


def check_stations(df: DataFrame) -> DataFrame:
    """Repeated depths in a hole, and azimuths and dips out of range."""
    w = Window.partitionBy("hole_id").orderBy("depth")
    x = df.withColumn("_again", F.col("depth") == F.lag("depth").over(w))
    one = x.agg(_bad(F.col("_again")).alias("repeated_depth"), _bad(~F.col("azimuth_deg").between(0, 360)).alias("azimuth"), _bad(~F.col("dip_deg").between(-90, 90)).alias("dip"))
    return _unpivoted(one, "survey")


def check_intervals(df: DataFrame, table: str) -> DataFrame:
    """Lengths of zero or less, and holes with an interval that starts above the previous one's end."""
    w = Window.partitionBy("hole_id").orderBy("from_m", "to_m")
    x = df.withColumn("_over", F.coalesce(F.col("from_m") < F.lag("to_m").over(w), F.lit(False)))
    holes = x.groupBy("hole_id").agg(F.max("_over").alias("over"), _bad(F.col("to_m") <= F.col("from_m")).alias("n"))
    one = holes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("no_length"), _bad(F.col("over")).alias("overlapping_holes"))
    return _unpivoted(one, table)


def check_depths(intervals: DataFrame, collars: DataFrame) -> DataFrame:
    """Intervals that end below their hole; holes without a collar are not judged."""
    depth = collars.groupBy("hole_id").agg(F.max("total_depth").alias("total"))
    one = intervals.join(depth, "hole_id", "left").agg(_bad(F.col("to_m") > F.col("total")).alias("below_hole"))
    return _unpivoted(one, "assay")


def summary(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count_distinct("hole_id").alias("holes"), F.count(F.lit(1)).alias("n"), F.sum(F.col("to_m") - F.col("from_m")).alias("metres"))


def report(tables: dict[str, DataFrame], checks: list[DataFrame]) -> DataFrame:
    """By table: rows, distinct holes, metres (null without depths), rows at fault by its checks, and whether it passes."""
    out = []
    for name, df in tables.items():
        metres = F.sum(F.col("to_m") - F.col("from_m")) if {"from_m", "to_m"} <= set(df.columns) else F.lit(None).cast("double")
        out.append(df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hole_id").alias("holes"), metres.alias("metres")).select(F.lit(name).alias("table_name"), "*"))
    faults = reduce(DataFrame.unionByName, checks).groupBy("table_name").agg(F.sum("n").alias("faults"))
    joined = reduce(DataFrame.unionByName, out).join(faults, "table_name", "left").withColumn("faults", F.coalesce("faults", F.lit(0)))
    return joined.withColumn("passes", F.col("faults") == 0)


def box_cover(points: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of the points in a box, percent, and share of the data's extent that the box covers, by axis."""
    inside = F.lit(True)
    for axis, (lo, hi) in box.items():
        inside = inside & F.col(axis).between(lo, hi)
    shares = []
    for axis, (lo, hi) in box.items():
        least, most = F.min(axis), F.max(axis)
        part = F.greatest(F.lit(0.0), F.least(most, F.lit(float(hi))) - F.greatest(least, F.lit(float(lo))))
        shares.append(F.try_divide(part, most - least).alias(f"overlap_{axis}"))
    return points.agg((100 * F.avg(inside.cast("double"))).alias("inside_pct"), *shares)


def require(df: DataFrame, columns: list[str], least: int = 10) -> None:
    """Raise unless the columns exist, hold neither null nor not-a-number, and there are rows enough."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    bad = [_bad(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *bad).first()
    if any(one[c] for c in columns):
        raise ValueError("conditioning data has missing values")
    if one["_n"] < least:
        raise ValueError(f"{one['_n']} rows, {least} needed")
