"""Order statistics over whole tables: ranges are sorted apart, and only totals by range meet in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running(df: DataFrame, order: list[str], sums: dict[str, Column], most: dict[str, Column] | None = None, inclusive: bool = True) -> DataFrame:
    """Adds running sums and maxima in the order of the columns ``order``, which should leave no ties,
    and for each sum ``<name>_total``, the sum of all rows.

    Rows are dealt out by ranges; a range's own running values are lifted by
    those of the ranges before it, of which there are as many as partitions.
    Ranges are drawn by a sample that differs each time it is taken, so the
    rows are written once with the number of theirs.
    """
    most = most or {}
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumns({f"_{k}": c for k, c in (sums | most).items()})
    held = stored(held.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = held.groupBy("_part").agg(*[F.sum(f"_{k}").alias(k) for k in sums], *[F.max(f"_{k}").alias(k) for k in most])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    parts = parts.select(
        "_part",
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_base_{k}") for k in sums],
        *[F.sum(k).over(everything).alias(f"{k}_total") for k in sums],
        *[F.max(k).over(before).alias(f"_base_{k}") for k in most],
    )
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    held = held.withColumns({f"_in_{k}": F.sum(f"_{k}").over(own) for k in sums} | {f"_in_{k}": F.max(f"_{k}").over(own) for k in most})
    out = held.join(F.broadcast(parts), "_part")
    return out.select(
        *df.columns,
        *[(F.coalesce(f"_in_{k}", F.lit(0)) + F.col(f"_base_{k}")).alias(k) for k in sums],
        *[f"{k}_total" for k in sums],
        *[F.greatest(f"_in_{k}", f"_base_{k}").alias(k) for k in most],
    )


def running_by(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """As ``running`` with sums that begin anew in each group, ``<name>_total`` being the group's.  One sort serves all
    groups, and a group lies over as many ranges as it needs; what is joined back has a row for each group."""
    out = running(df.withColumns({f"_of_{k}": c for k, c in sums.items()}), [*by, *order], {k: F.col(f"_of_{k}") for k in sums}, inclusive=inclusive)
    whole = out.groupBy(*by).agg(*[F.sum(f"_of_{k}").alias(f"_sum_{k}") for k in sums], *[F.min_by(k, F.struct(*order)).alias(f"_low_{k}") for k in sums], *[F.min_by(f"_of_{k}", F.struct(*order)).alias(f"_first_{k}") for k in sums])
    whole = whole.withColumnsRenamed({c: f"_by_{c}" for c in by})
    out = out.join(whole, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])
    base = {k: F.col(f"_low_{k}") - (F.col(f"_first_{k}") if inclusive else F.lit(0)) for k in sums}
    return out.select(*df.columns, *[(F.col(k) - base[k]).alias(k) for k in sums], *[F.col(f"_sum_{k}").alias(f"{k}_total") for k in sums])


def counted(df: DataFrame, value: str) -> DataFrame:
    """Distinct values (``v``) with their number ``n`` and how many values are smaller (``below``, of ``below_total``)."""
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return running(v, ["v"], {"below": F.col("n")}, inclusive=False)


def quantiles(df: DataFrame, value: str, marks: list[float]) -> DataFrame:
    """Rows ``k, p, q``: the exact quantiles at the marks, linear between ranks, as ``percentile`` has them.

    The values at the ranks on either side of a mark are picked from sorted
    ranges, so no task holds all distinct values.  No values, no rows.
    """
    ps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(marks)])
    last = F.col("below_total") - 1
    upto = F.col("below") + F.col("n")
    here = F.filter(ps, lambda s: (F.ceil(s["p"] * last) >= F.col("below")) & (F.floor(s["p"] * last) < upto))
    near = counted(df, value).select("v", "below", upto.alias("upto"), last.alias("last"), F.explode(here).alias("s")).select("*", "s.k", "s.p")
    at = F.col("p") * F.col("last")
    holds = lambda rank: (rank >= F.col("below")) & (rank < F.col("upto"))
    ends = near.groupBy("k", "p", "last").agg(F.max(F.when(holds(F.floor(at)), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias("hi"))
    share = at - F.floor(at)
    return ends.select("k", "p", (F.col("lo") * (1 - share) + F.col("hi") * share).alias("q"))


def quantile_row(df: DataFrame, value: str, marks: dict[str, float]) -> DataFrame:
    """One row with a column for each named mark."""
    q = quantiles(df, value, list(marks.values()))
    return q.agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in enumerate(marks)])
