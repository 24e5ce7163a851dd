"""Comparisons of two models or of data with simulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import even_bin, floor_bin
from . import order


def errors(df: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    d = F.col(guess) - F.col(truth)
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.corr(truth, guess).alias("r"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) >= 3).cast("double")).alias("share_3"))
    return one.crossJoin(F.broadcast(order.quantile_row(df, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}))).select("n", "mean", "std", "p10", "p50", "p90", "share_3")


def histogram_overlap(a: DataFrame, b: DataFrame, va: str, vb: str, bins: int = 50) -> DataFrame:
    """Shared area of two densities over equal bins of their joint range; the last bin is closed."""
    both = a.select(F.col(va).alias("v"), F.lit(1).alias("a")).unionByName(b.select(F.col(vb).alias("v"), F.lit(0).alias("a"))).filter("v IS NOT NULL")
    ends = both.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("na"), F.sum(1 - F.col("a")).alias("nb"))
    k = F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
    x = both.crossJoin(F.broadcast(ends)).withColumn("k", k)
    each = x.groupBy("k", "na", "nb").agg(F.sum("a").alias("ca"), F.sum(1 - F.col("a")).alias("cb"))
    return each.agg(F.sum(F.least(F.col("ca") / F.col("na"), F.col("cb") / F.col("nb"))).alias("overlap"))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The n rows of least seeded digest of the key; the limit is the feature."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def quantile_profile(a: DataFrame, b: DataFrame, va: str, vb: str, marks: int = 99, ends: bool = False) -> DataFrame:
    """Correlation, root mean square and bias of two distributions' quantiles at so many marks between 0 and 1, with ``ends``
    at 0 and 1 as well."""
    ps = [(k + 1) / (marks + 1) for k in range(marks)]
    ps = [0.0, *ps, 1.0] if ends else ps
    x = order.quantiles(a, va, ps).select("k", F.col("q").alias("x"))
    y = order.quantiles(b, vb, ps).select("k", F.col("q").alias("y"))
    return errors(x.join(y, "k"), "x", "y")


def to_support(blocks: DataFrame, origin: tuple[float, float, float], step: tuple[float, float, float], shape: tuple[int | None, int | None, int | None], cell_volume: float) -> DataFrame:
    """Fine blocks gathered in the nearest coarse cell: count, volume, tonnage, grade by mass, filled fraction.
    Blocks whose nearest cell lies outside the grid are left out; an axis of no given length is open on both sides."""
    x = blocks
    for a, o, s in zip("xyz", origin, step, strict=True):
        x = x.withColumn(f"i{a}", even_bin(F.col(a), o, s))
    for a, n in zip("xyz", shape, strict=True):
        x = x if n is None else x.filter(F.col(f"i{a}").between(0, n - 1))
    t = F.col("volume") * F.col("density")
    out = x.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.sum(t).alias("tonnage"), (F.sum(F.col("grade") * t) / F.sum(t)).alias("grade"))
    return out.withColumn("filled", F.col("volume") / cell_volume)


def model_curve(blocks: DataFrame, cutoffs: list[float]) -> DataFrame:
    """Tonnage, tonnage-weighted grade, and shares of volume and tonnage at or above each cutoff, in one pass."""
    t = F.col("volume") * F.col("density")
    sums = [F.sum("volume").alias("v"), F.sum(t).alias("t")]
    for k, c in enumerate(cutoffs):
        at = F.col("grade") >= c
        sums += [F.coalesce(F.sum(F.when(at, x)), F.lit(0.0)).alias(f"{n}{k}") for n, x in (("v", F.col("volume")), ("t", t), ("g", t * F.col("grade")))]
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.col(f"t{k}").alias("tonnage"), F.when(F.col(f"t{k}") > 0, F.col(f"g{k}") / F.col(f"t{k}")).otherwise(0.0).alias("avg_grade"), (F.col(f"v{k}") / F.col("v")).alias("volume_share"), (F.col(f"t{k}") / F.col("t")).alias("tonnage_share")) for k, c in enumerate(cutoffs)])
    return blocks.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def curve_change(base: DataFrame, other: DataFrame) -> DataFrame:
    """Percent change of tonnage and grade at each cutoff of the base."""
    o = other.select("cutoff", F.col("tonnage").alias("t2"), F.col("avg_grade").alias("g2"))
    pct = lambda n, d: F.when(d != 0, 100 * (n - d) / d)
    return base.join(o, "cutoff", "left").select("cutoff", "tonnage", "avg_grade", pct(F.col("t2"), F.col("tonnage")).alias("tonnage_change_pct"), pct(F.col("g2"), F.col("avg_grade")).alias("grade_change_pct"))


def axis_means(df: DataFrame, axis: str, value: str, origin: float, step: float, n: int) -> DataFrame:
    """Mean of each left-closed bin along an axis; bins without data stay, with null."""
    means = df.withColumn("bin", floor_bin(F.col(axis), origin, step)).filter(F.col("bin").between(0, n - 1)).groupBy("bin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return df.sparkSession.range(n).select(F.col("id").alias("bin")).join(means, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def infer_spacing(df: DataFrame, column: str, fallback: float) -> DataFrame:
    """Median of the positive steps between neighbouring distinct values, else the fallback."""
    d = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").distinct()
    before = order.running(d, ["v"], {}, {"before": F.col("v")}, inclusive=False)
    steps = before.select((F.col("v") - F.col("before")).alias("step")).filter("step > 0")
    return order.quantile_row(steps, "step", {"spacing": 0.5}).select(F.coalesce("spacing", F.lit(float(fallback))).alias("spacing"))


def coverage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Percent of rows for which each condition holds."""
    return df.agg(*[(100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))).alias(n) for n, c in columns.items()])


def binned_median(df: DataFrame, x: str, edges: list[float], y: str) -> DataFrame:
    """Median of y in classes of x, left-closed and the last one closed."""
    k = F.lit(None).cast("int")
    out = F.when(F.lit(False), k)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = (F.col(x) >= a) & ((F.col(x) < b) if i < len(edges) - 2 else (F.col(x) <= b))
        out = out.when(inside, F.lit(i))
    return df.withColumn("class", out).filter("class IS NOT NULL").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.median(y).alias("median"))


def reproduction(df: DataFrame, weights: dict[str, float], least_pairs: int = 10) -> DataFrame:
    """By direction: RMSE, MAE and bias of simulated against target variograms on lags with pairs enough,
    and how many lags have them; ``weighted_rmse`` with weights over the directions there are."""
    ok = (F.col("target_pairs") >= least_pairs) & F.col("gamma_sim_mean").isNotNull()
    d = F.when(ok, F.col("gamma_sim_mean") - F.col("gamma_target"))
    each = df.groupBy("direction").agg(F.count(F.lit(1)).alias("lags"), F.count_if(ok).alias("usable"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"))
    known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    each = each.withColumn("_w", F.when(F.col("rmse").isNotNull(), known[F.col("direction")]))
    total = each.agg((F.sum(F.col("_w") * F.col("rmse")) / F.sum("_w")).alias("weighted_rmse"))
    return each.crossJoin(F.broadcast(total)).drop("_w")


def width_reduction(dense: DataFrame, sparse: DataFrame, cutoff: float) -> DataFrame:
    """Tonnage between P10 and P90 at a cutoff by two curve summaries, and by how many percent the first is narrower."""
    at = lambda df, n: df.filter(F.col("cutoff") == cutoff).agg(F.max(F.col("tonnage_p90") - F.col("tonnage_p10")).alias(n))
    both = at(dense, "dense_width").crossJoin(F.broadcast(at(sparse, "sparse_width")))
    return both.withColumn("reduction_pct", F.when(F.col("sparse_width") > 0, 100 * (F.col("sparse_width") - F.col("dense_width")) / F.col("sparse_width")).otherwise(0.0))


def support_ladder(metrics: DataFrame) -> DataFrame:
    """Metrics by support (``support, metric, value``) side by side, and each relative to the smallest support's.
    ``support`` counts fine cells; the number of supports is a handful by nature."""
    first = metrics.groupBy("metric").agg(F.min_by("value", "support").alias("base"))
    return metrics.join(first, "metric").select("support", "metric", "value", F.when(F.abs("base") > 1e-9, F.col("value") / F.col("base")).alias("relative"))
