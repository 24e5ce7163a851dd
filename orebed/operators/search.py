"""Search over model parameters: candidates, their scores with penalties, and the best of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The pools that candidates are made of; search radii are strike, dip and normal, bounds are least and most neighbours.
POOLS: dict[str, list] = {
    "target_range": [130.0, 140.0, 150.0, 160.0, 170.0],
    "nugget_ratio": [0.16, 0.20, 0.24],
    "normal_range": [60, 70, 80, 90],
    "search_radii": [[240, 120, 70], [250, 120, 70], [260, 130, 80]],
    "neighbours": [[8, 24], [10, 28]],
}
# What a metric must reach, or may not exceed.
AT_LEAST = {"hist_overlap": 0.97, "swath_corr_x": 0.50, "swath_corr_y": 0.50, "swath_corr_z": 0.35}
AT_MOST = {"qq_rmse": 0.10}


def candidates(spark: SparkSession, most: int, seed: int = 1337, pools: dict[str, list] | None = None) -> DataFrame:
    """Rows ``candidate`` and a column for each pool: all combinations, the last pool's values changing
    fastest, or ``most`` of them by the order of a seeded digest, with the numbers that they had."""
    df, number = spark.range(1), F.lit(0)
    for name, values in (pools or POOLS).items():
        df = df.select("*", F.posexplode(F.lit(values)).alias(f"_{name}", name))
        number = number * len(values) + F.col(f"_{name}")
    df = df.select(number.alias("candidate"), *(pools or POOLS))
    return df.orderBy(F.md5(F.concat(F.col("candidate").cast("string"), F.lit(f":{seed}"))), "candidate").limit(most)


def variogram_errors(df: DataFrame, variogram: DataFrame, reach: str = "target_range", nugget: str = "nugget_ratio", sill: float = 1.0) -> DataFrame:
    """Adds ``weighted_rmse``: how far an exponential model of each candidate's range and nugget ratio lies from a variogram
    (``distance, gamma, pairs``), lags weighed by their pairs; null without lags.

    The variogram, a row a lag, goes along with each candidate as one array."""
    lags = variogram.filter("pairs > 0").agg(F.array_sort(F.collect_list(F.struct("distance", "gamma", F.col("pairs").cast("double").alias("pairs")))).alias("_lags"))
    model = lambda x: sill * (1 - (1 - F.col(nugget)) * F.exp(-x["distance"] / F.col(reach)))
    add = lambda f: F.aggregate("_lags", F.lit(0.0), lambda s, x: s + f(x))
    error, weight = add(lambda x: x["pairs"] * F.pow(model(x) - x["gamma"], 2)), add(lambda x: x["pairs"])
    return df.crossJoin(F.broadcast(lags)).withColumn("weighted_rmse", F.when(F.size("_lags") > 0, F.sqrt(error / weight))).drop("_lags")


def _over(value: Column, limit: float) -> Column:
    """How far a value lies over a limit; 0 below it, and for null and not-a-number."""
    return F.when((value > limit) & ~F.isnan(value), value - limit).otherwise(0.0)


def failures(value: Callable[[str], Column] = F.col) -> Column:
    """Names of the metrics that miss their limit; a metric that is null misses it, not-a-number does not."""
    low = [F.when(F.coalesce(value(n) < limit, F.lit(True)), F.lit(n)) for n, limit in AT_LEAST.items()]
    high = [F.when(F.coalesce((value(n) > limit) & ~F.isnan(value(n)), F.lit(True)), F.lit(n)) for n, limit in AT_MOST.items()]
    return F.array_compact(F.array(*low, *high))


def scored(metrics: DataFrame, balanced: bool = False) -> DataFrame:
    """Adds ``failures``, ``ok`` and ``score``, of which less is better.

    The score is ``weighted_rmse`` with penalties for a poor fit along strike (``along_strike_rmse``,
    ``along_strike_bias``), for lags without pairs (``total_missing_lags``), and for each limit that is
    missed.  ``balanced`` asks for a mean swath correlation of 0.55 besides.  Without a finite
    ``weighted_rmse`` a row has score 999 and isn't ok.
    """
    c = lambda n: F.col(n).cast("double")
    bias, weighted = c("along_strike_bias"), c("weighted_rmse")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    along = F.when(finite(c("along_strike_rmse")), c("along_strike_rmse"))
    penalty = 1.5 * _over(along, 0.5) + 0.05 * _over(c("total_missing_lags"), 2.0)
    penalty += F.when(finite(bias) & (bias < -0.2), 0.7 * F.abs(bias + 0.2)).otherwise(0.0)
    missed = failures(c)
    penalty += 5.0 * F.size(missed) + 20.0 * _over(c("qq_rmse"), AT_MOST["qq_rmse"])
    penalty += 20.0 * _over(-c("hist_overlap"), -AT_LEAST["hist_overlap"])
    if balanced:
        mean = sum((F.coalesce(c(f"swath_corr_{a}"), F.lit(0.0)) for a in "yz"), F.coalesce(c("swath_corr_x"), F.lit(0.0))) / 3
        penalty += 0.4 * _over(-mean, -0.55)
    known = finite(weighted)
    return metrics.select(
        "*",
        F.when(known, missed).otherwise(F.array(F.lit("weighted_rmse"))).alias("failures"),
        (known & (F.size(missed) == 0)).alias("ok"),
        F.when(known, weighted + penalty).otherwise(999.0).alias("score"),
    )


def best(df: DataFrame, n: int = 1) -> DataFrame:
    """The n candidates of least score that miss no limit; equal scores by number.  The feature is the limit."""
    return df.filter("ok").orderBy("score", "candidate").limit(n)


def search(df: DataFrame, screen: Callable[[DataFrame], DataFrame], confirm: Callable[[DataFrame], DataFrame], keep: int = 3, balanced: bool = False) -> DataFrame:
    """The best candidate, or no row: all are screened, the best ``keep`` are tried again by ``confirm``.
    Both functions take candidates and return them with the columns that ``scored`` reads."""
    chosen = best(scored(screen(df), balanced), keep).select(*df.columns)
    return best(scored(confirm(chosen), balanced))
