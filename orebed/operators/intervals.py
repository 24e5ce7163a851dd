"""Operators on depth intervals: islands, compositing, stab and overlap joins, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import overlap


def islands(df: DataFrame, by: str = "hole_id", category: str = "lith_code", start: str = "from_m", end: str = "to_m") -> DataFrame:
    """Adds ``island`` and its ``island_from`` and ``island_to``: runs of one category down a hole.
    A null category always begins a new run."""
    down = Window.partitionBy(by).orderBy(start, end)
    new = F.coalesce((F.col(category) != F.lag(category).over(down)).cast("int"), F.lit(1))
    df = df.withColumn("island", F.sum(new).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(by, "island")
    return df.withColumn("island_from", F.min(start).over(run)).withColumn("island_to", F.max(end).over(run))


def composites(df: DataFrame, length: float = 2.0, least: float = 0.5, tolerance: float = 0.001, grade: str = "grade", missing_as_zero: bool = True, coordinates: tuple[str, ...] = ()) -> DataFrame:
    """Length-weighted grades of fixed bins inside islands.

    Bins start at the island's top; the last is short and bins shorter than
    ``least`` are left out.  An interval explodes into the few bins that it
    meets, so no interval is joined with bins it has no part in.  A null grade
    keeps its length in the denominator (``missing_as_zero``) or not.
    """
    df = islands(df)
    top, bottom = F.col("island_from"), F.col("island_to")
    first = F.floor((F.col("from_m") - top) / length)
    last = F.greatest(first, F.ceil((F.col("to_m") - top) / length) - 1)
    df = df.withColumn("bin", F.explode(F.sequence(first, last)))
    lo = top + F.col("bin") * length
    hi = F.least(lo + length, bottom)
    df = df.withColumns({"bin_from": lo, "bin_to": hi, "part": overlap(F.col("from_m"), F.col("to_m"), lo, hi)})
    df = df.filter((F.col("part") > tolerance) & (F.col("bin_to") - F.col("bin_from") >= least))
    weight = F.sum("part") if missing_as_zero else F.sum(F.when(F.col(grade).isNotNull(), F.col("part")))
    sums = [(F.sum(F.col(c) * F.col("part")) / F.sum("part")).alias(c) for c in coordinates]
    return df.groupBy("hole_id", "island", "lith_code", "bin", "bin_from", "bin_to").agg((F.coalesce(F.sum(F.col(grade) * F.col("part")), F.lit(0.0)) / weight).alias("grade"), *sums).select(
        "hole_id", "lith_code", F.col("bin_from").alias("from_m"), F.col("bin_to").alias("to_m"), (F.col("bin_to") - F.col("bin_from")).alias("length"), "grade", *coordinates
    )


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long")))


def stab(points: DataFrame, spans: DataFrame, value: str, by: str = "hole_id", at: str = "mid", tie: str | None = None, width: float = 16.0, own: str | None = None, unknown: str | None = None) -> DataFrame:
    """For each point, the value of the span [from_m, to_m) that holds it.  Where none does, the point keeps
    its ``own`` value, if that column is named, and without one (null, empty, ``nan`` or ``None``) has ``unknown``.

    Of several the one that starts first counts, then by ``tie``.  Spans and
    points meet in depth buckets, an equi-join, not in a nested loop.
    ``points`` needs a unique ``point_id``.
    """
    s = spans.select(F.col(by).alias("_by"), F.col("from_m").alias("_from"), F.col("to_m").alias("_to"), F.col(value).alias("_value"), (F.col(tie) if tie else F.lit(0)).alias("_tie"))
    s = s.withColumn("_bucket", _buckets(F.col("_from"), F.col("_to"), width))
    p = points.withColumn("_bucket", F.floor(F.col(at) / width).cast("long"))
    hit = p.join(s, (F.col(by) == F.col("_by")) & (p["_bucket"] == s["_bucket"]) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to")))
    best = hit.groupBy("point_id").agg(F.min_by("_value", F.struct("_from", "_tie")).alias(value))
    out = points.join(best, "point_id", "left")
    if own is not None:
        kept = F.when(~F.coalesce(F.trim(F.col(own).cast("string")), F.lit("")).isin("", "nan", "None"), F.col(own))
        out = out.withColumn(value, F.coalesce(value, kept))
    return out if unknown is None else out.withColumn(value, F.coalesce(value, F.lit(unknown)))


def most_overlap(base: DataFrame, spans: DataFrame, value: str, by: str = "hole_id", tie: str = "span_id", width: float = 16.0) -> DataFrame:
    """For each base interval (unique ``base_id``), the value of the span it shares most length with,
    that length and whether there is one; of equal lengths the first span counts."""
    s = spans.select(F.col(by).alias("_by"), F.col("from_m").alias("_from"), F.col("to_m").alias("_to"), F.col(value).alias("_value"), F.col(tie).alias("_tie"))
    s = s.withColumn("_bucket", _buckets(F.col("_from"), F.col("_to"), width))
    b = base.withColumn("_bucket", _buckets(F.col("from_m"), F.col("to_m"), width))
    part = overlap(F.col("from_m"), F.col("to_m"), F.col("_from"), F.col("_to"))
    hit = b.join(s, (F.col(by) == F.col("_by")) & (b["_bucket"] == s["_bucket"])).withColumn("_part", part).filter("_part > 0")
    best = hit.groupBy("base_id").agg(F.max_by(F.struct("_value", "_part"), F.struct("_part", -F.col("_tie"))).alias("_best"))
    out = base.join(best, "base_id", "left")
    return out.select(*base.columns, F.col("_best._value").alias(value), F.coalesce("_best._part", F.lit(0.0)).alias("overlap_m"), F.col("_best").isNotNull().alias("matched"))


def contacts(df: DataFrame, category: Column, gap: float = 0.25) -> DataFrame:
    """Depths in each hole where the category of neighbours differs and at most ``gap`` lies between:
    the end of the upper one."""
    down = Window.partitionBy("hole_id").orderBy("from_m", "to_m")
    x = df.withColumn("_c", category)
    x = x.select("hole_id", "to_m", "_c", F.lead("_c").over(down).alias("_next"), F.lead("from_m").over(down).alias("_from"))
    return x.filter((F.col("_c") != F.col("_next")) & (F.abs(F.col("_from") - F.col("to_m")) <= gap)).select("hole_id", F.col("to_m").alias("contact_depth_m"))


def contact_distances(df: DataFrame, category: Column, reach: float = 10.0) -> DataFrame:
    """Rows within reach of their nearest contact, with the signed distance from it.

    The nearest contact lies right above or right below a row, so one window
    over rows and contacts together finds both; of equal ones the upper counts.
    """
    marks = contacts(df, category)
    mid = (F.col("from_m") + F.col("to_m")) / 2
    rows = df.withColumn("_c", category).select("hole_id", mid.alias("d"), F.lit(None).cast("double").alias("at"), F.struct(*df.columns, F.col("_c").alias("category")).alias("row"))
    both = rows.unionByName(marks.select("hole_id", F.col("contact_depth_m").alias("d"), F.col("contact_depth_m").alias("at"), F.lit(None).alias("row")), allowMissingColumns=True)
    w = Window.partitionBy("hole_id").orderBy("d", F.col("at").isNull())
    above = F.last("at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"above": above, "below": below}).filter("row IS NOT NULL")
    nearest = F.when(F.col("below").isNull() | (F.col("d") - F.col("above") <= F.col("below") - F.col("d")), F.col("above")).otherwise(F.col("below"))
    out = both.withColumn("contact_depth_m", nearest).filter("contact_depth_m IS NOT NULL").withColumn("signed_distance_m", F.col("d") - F.col("contact_depth_m"))
    return out.filter(F.abs("signed_distance_m") <= reach).select("row.*", "contact_depth_m", "signed_distance_m")
