"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, dropped, scratch


def components(edges: DataFrame) -> DataFrame:
    """Rows ``node, component`` for the nodes of ``edges`` (``a, b``): the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris and others, 2014),
    each written to the shared folder, until nothing changes.  No node's
    neighbours are ever gathered: a step takes their minimum and joins it back.
    """
    spark = edges.sparkSession
    old, made = None, []

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        path = scratch(spark, "stars")
        df.write.parquet(path)
        made.append(path)
        out = spark.read.schema(df.schema).parquet(path)
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, mark = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark != old and mark[0]:
        old = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(again("a").alias("a"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, _ = written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.select(again("a").alias("a"), "m"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, mark = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        dropped(spark, *made[:-1])
        del made[:-1]
    tops = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select(F.col("b").alias("node"), F.col("b").alias("component")))
