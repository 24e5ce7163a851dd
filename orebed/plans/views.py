"""Drillhole, ensemble and block views over the star-schema tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Assay intervals down each hole, end to end."""
    length = (3 + F.col("event_id") % 8).cast("double") / 4
    down = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", length.alias("length"), F.sum(length).over(down).alias("to_m"))
    return e.select(F.concat(F.lit("H"), "user_id").alias("hole_id"), "event_id", (F.col("to_m") - F.col("length")).alias("from_m"), "to_m", "length", F.col("event_type").alias("lith_code"), F.col("value").alias("grade"), "user_id")


def collars(spark: SparkSession, sf: str) -> DataFrame:
    i = intervals(spark, sf).groupBy("hole_id", "user_id").agg(F.max("to_m").alias("total_depth"))
    return i.select("hole_id", (100.0 * (F.col("user_id") % 15)).alias("x"), (100.0 * F.floor(F.col("user_id") / 15)).alias("y"), F.lit(100.0).alias("z"), "total_depth")


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth interval's top as a survey station, and one at depth 0 for each hole."""
    i = intervals(spark, sf)
    tenth = i.filter("event_id % 10 = 0").select("hole_id", F.col("from_m").alias("depth"), (F.col("event_id") * 37 % 360).cast("double").alias("azimuth_deg"), (-(45 + F.col("event_id") % 45)).cast("double").alias("dip_deg"))
    return tenth


def lithology(spark: SparkSession, sf: str) -> DataFrame:
    """Every third interval, two metres longer: overlaps and gaps."""
    return intervals(spark, sf).filter("event_id % 3 = 0").select("hole_id", "from_m", (F.col("to_m") + 2.0).alias("to_m"), "lith_code", F.col("event_id").alias("lith_id"))


def stack(spark: SparkSession, sf: str) -> DataFrame:
    """An ensemble: realisation, cell, its place in the grid, value."""
    s = _read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).cast("int").alias("real_id"), F.col("l_partkey").alias("cell_id")).agg(F.avg("l_quantity").alias("value"))
    return s.select("real_id", "cell_id", *_place(), "value")


def _place() -> list:
    c = F.col("cell_id")
    return [(c % 20).alias("ix"), (F.floor(c / 20) % 20).cast("long").alias("iy"), F.floor(c / 400).cast("long").alias("iz")]


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """A category for each cell of each realisation: 0 waste, 1 and 2 ore."""
    return stack(spark, sf).withColumn("category_id", (F.floor(F.col("value") * 7) % 3).cast("int"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("xyz")], F.col("label").alias("label"), (F.col("embedding")[3].cast("double") * 10 + F.col("label")).alias("value"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    p = _read(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("block_id"), (k % 20 * 12.5).cast("double").alias("x"), (F.floor(k / 20) % 20 * 12.5).cast("double").alias("y"), (F.floor(k / 400) * 2.5).cast("double").alias("z"), (F.col("p_size") / 10.0).alias("grade"), (F.col("p_retailprice") / 100.0).alias("volume"), F.col("p_type").alias("density_class"), (2.0 + F.col("p_size") % 7 / 10.0).alias("density"))


SQL = {
    "intervals": "intervals AS (SELECT 'H' || user_id AS hole_id, event_id, to_m - length AS from_m, to_m, length, event_type AS lith_code, value AS grade, user_id FROM (SELECT *, sum(length) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_m FROM (SELECT *, CAST(3 + event_id % 8 AS DOUBLE) / 4 AS length FROM events)))",
    "collars": "collars AS (SELECT hole_id, CAST(100 * (user_id % 15) AS DOUBLE) AS x, CAST(100 * (user_id // 15) AS DOUBLE) AS y, CAST(100 AS DOUBLE) AS z, max(to_m) AS total_depth FROM intervals GROUP BY hole_id, user_id)",
    "stations": "stations AS (SELECT hole_id, from_m AS depth, CAST(event_id * 37 % 360 AS DOUBLE) AS azimuth_deg, CAST(-(45 + event_id % 45) AS DOUBLE) AS dip_deg FROM intervals WHERE event_id % 10 = 0)",
    "lithology": "lithology AS (SELECT hole_id, from_m, to_m + 2 AS to_m, lith_code, event_id AS lith_id FROM intervals WHERE event_id % 3 = 0)",
    "stack": "stack AS (SELECT *, cell_id % 20 AS ix, cell_id // 20 % 20 AS iy, cell_id // 400 AS iz FROM (SELECT CAST(l_suppkey % 10 AS INT) AS real_id, l_partkey AS cell_id, avg(l_quantity) AS value FROM lineitem GROUP BY ALL))",
    "categories": "categories AS (SELECT *, CAST(CAST(floor(value * 7) AS BIGINT) % 3 AS INT) AS category_id FROM stack)",
    "points": "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, label, CAST(embedding[4] AS DOUBLE) * 10 + label AS value FROM embeddings)",
    "blocks": "blocks AS (SELECT p_partkey AS block_id, CAST(p_partkey % 20 AS DOUBLE) * 12.5e0 AS x, CAST(p_partkey // 20 % 20 AS DOUBLE) * 12.5e0 AS y, CAST(p_partkey // 400 AS DOUBLE) * 2.5e0 AS z, CAST(p_size AS DOUBLE) / 10e0 AS grade, p_retailprice / 100e0 AS volume, p_type AS density_class, 2e0 + CAST(p_size % 7 AS DOUBLE) / 10e0 AS density FROM part)",
}
_NEEDS = {"collars": ["intervals"], "stations": ["intervals"], "lithology": ["intervals"], "categories": ["stack"]}


def with_views(*names: str) -> str:
    """A WITH clause, open for further tables, that defines the named views."""
    order: list[str] = []
    for n in names:
        for k in [*_NEEDS.get(n, []), n]:
            if k not in order:
                order.append(k)
    return "WITH " + ", ".join(SQL[k] for k in order)
