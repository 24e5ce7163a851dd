"""Validation: resampled holes, paired tests, random subsets of an ensemble, classes held out by hole, plan patterns, envelopes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import entropy
from ..sources.scratch import stored
from . import order

#: Chances that a Poisson number of mean 1 is at most 0, 1, 2 ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def digest_uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1 from the MD5 digest of the parts, joined by colons: the same on any cluster."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def poisson(u: Column) -> Column:
    """The Poisson number of mean 1 at a uniform number."""
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def _real(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def cluster_bootstrap(df: DataFrame, value: str, group: str, cluster: str, a, b, resamples: int = 1000, seed: int = 1337) -> DataFrame:
    """One row: the difference of means of group ``a`` less group ``b``, and the 2.5, 50 and 97.5 percent marks of it over
    resamples of whole clusters (holes).

    A resample takes each cluster a Poisson number of times, drawn from a digest
    of the cluster, so that parts of it on different tasks agree.  Rows are
    first summed by cluster and group; what is copied for each resample is a
    row for each cluster.  Resamples in which a group is not drawn are left out
    (``drawn`` counts the others); without rows in both groups all marks are null.
    """
    one = lambda g, what: F.sum(F.when(F.col(group) == F.lit(g), what))
    v, n = F.col(value).cast("double"), F.lit(1)
    sums = df.filter(_real(value) & F.col(group).isin(a, b) & F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster"))
    sums = sums.agg(one(a, v).alias("sa"), one(a, n).alias("na"), one(b, v).alias("sb"), one(b, n).alias("nb")).na.fill(0)
    sums = stored(sums, "clusters")
    draws = sums.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draws = draws.withColumn("times", poisson(digest_uniform("cluster", F.lit(seed), "resample"))).filter("times > 0")
    means = draws.groupBy("resample").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in ("sa", "na", "sb", "nb")])
    means = means.filter("na > 0 AND nb > 0").select((F.col("sa") / F.col("na") - F.col("sb") / F.col("nb")).alias("d"))
    marks = means.agg(F.count(F.lit(1)).alias("drawn"), *[F.percentile("d", F.lit(p)).alias(m) for m, p in (("p025", 0.025), ("p500", 0.5), ("p975", 0.975))])
    whole = sums.agg(F.count(F.lit(1)).alias("clusters"), F.when((F.sum("na") > 0) & (F.sum("nb") > 0), F.sum("sa") / F.sum("na") - F.sum("sb") / F.sum("nb")).alias("difference"))
    return whole.crossJoin(marks)  # one row each


def paired_differences(df: DataFrame, value: str, group: str, cluster: str, a, b) -> DataFrame:
    """Rows ``cluster, mean_a, mean_b, difference`` of the clusters that have values in both groups."""
    one = lambda g: F.avg(F.when(F.col(group) == F.lit(g), F.col(value).cast("double")))
    x = df.filter(_real(value) & F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(one(a).alias("mean_a"), one(b).alias("mean_b"))
    return x.dropna().withColumn("difference", F.col("mean_a") - F.col("mean_b"))


def signed_ranks(df: DataFrame, difference: str = "difference") -> DataFrame:
    """One row: Wilcoxon's signed-rank test of paired differences.

    Differences of 0 are left out (``zeros``); of equal sizes each has the mean
    of their ranks.  ``z`` and the two-sided ``p`` are normal, corrected for
    ties; null without differences.  Ranks come of running counts by size.
    """
    d = F.col(difference).cast("double")
    sizes = df.filter(_real(difference) & (d != 0)).groupBy(F.abs(d).alias("size")).agg(F.count(F.lit(1)).alias("m"), F.count_if(d > 0).alias("up"))
    sizes = order.running(sizes, ["size"], {"below": F.col("m")}, inclusive=False)
    rank, m = F.col("below") + (F.col("m") + 1) / 2, F.col("m").cast("double")
    zero = F.lit(0.0)
    one = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(rank * F.col("up")), zero).alias("w_plus"), F.coalesce(F.sum(rank * (F.col("m") - F.col("up"))), zero).alias("w_minus"), F.coalesce(F.sum(m * m * m - m), zero).alias("ties"))
    zeros = df.agg(F.count_if(d == 0).alias("zeros"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    out = one.crossJoin(zeros).withColumn("z", F.when((n > 0) & (spread > 0), (F.col("w_plus") - n * (n + 1) / 4) / spread))

    @F.pandas_udf("double")  # one row
    def two_sided(z: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else min(1.0, math.erfc(abs(v) / math.sqrt(2))) for v in z], dtype=float)

    return out.select("n", "zeros", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("statistic"), "z", two_sided("z").alias("p"))


def subset_members(n_real: int, sizes: list[int], draws: int, seed: int) -> dict[tuple[int, int], list[int]]:
    """Realisations of each random subset ``(size, draw)``: those with the least digests, without repeats."""
    import hashlib

    digest = lambda n, d, r: hashlib.md5(f"{n}:{d}:{r}:{seed}".encode()).hexdigest()
    return {(n, d): sorted(range(n_real), key=lambda r: (digest(n, d, r), r))[:n] for n in sizes for d in range(draws)}


def _row_quantiles(x: np.ndarray, marks: tuple[float, ...]) -> np.ndarray:
    """Quantiles of each row, linear between ranks, without its missing values; missing where a row has none."""
    x = np.sort(x, axis=1)
    n = np.isfinite(x).sum(1)
    out = np.full((len(marks), len(x)), np.nan)
    some = np.flatnonzero(n)
    for k, p in enumerate(marks):
        at = p * (n[some] - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n[some] - 1)
        out[k, some] = x[some, lo] + (at - lo) * (x[some, hi] - x[some, lo])
    return out


def subset_convergence(reals: DataFrame, n_real: int, sizes: list[int], draws: int, cutoff: float, seed: int = 20260706) -> DataFrame:
    """Rows ``size, draw, probability_mae, probability_r, spread_mae, spread_r, cells``: maps from random subsets of an
    ensemble's realisations (``real_id`` from 0, ``cell_id``, ``value``) against those from all of them.

    The probability is the share of a cell's values above the cutoff, the
    spread its P90 less its P10.  The stack is shuffled once, to a row of
    realisations for each cell; a task keeps a table of all subsets' members,
    and adds up what correlations and errors need by subset, so that no copy
    of the stack is made for any.  Missing values are left out of a cell's
    statistics; a cell without values in a subset doesn't count there.
    """
    members = subset_members(n_real, sizes, draws, seed)
    keys = list(members)
    wide = reals.filter(F.col("real_id").between(0, n_real - 1)).groupBy("cell_id").agg(F.collect_list(F.struct(F.col("real_id").cast("int").alias("r"), F.col("value").cast("double").alias("v"))).alias("held"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.full((len(batch), n_real), np.nan)
            for i, held in enumerate(batch["held"]):
                for e in held:
                    x[i, e["r"]] = np.nan if e["v"] is None else e["v"]
            rows = []

            def maps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                have = np.isfinite(values)
                n = have.sum(1)
                share = np.divide((have & (values > cutoff)).sum(1), n, out=np.full(len(values), np.nan), where=n > 0)
                low, high = _row_quantiles(values, (0.1, 0.9))
                return share, high - low

            whole = maps(x)
            for k, (n, d) in enumerate(keys):
                for name, one, every in zip(("probability", "spread"), maps(x[:, members[n, d]]), whole, strict=True):
                    ok = np.isfinite(one) & np.isfinite(every)
                    a, b = one[ok], every[ok]
                    rows.append((k, name, int(ok.sum()), np.abs(a - b).sum(), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()))
            yield pd.DataFrame(rows, columns=["k", "map", "n", "e", "a", "b", "aa", "bb", "ab"])

    parts = wide.mapInPandas(kernel, "k int, map string, n long, e double, a double, b double, aa double, bb double, ab double")
    sums = parts.groupBy("k", "map").agg(*[F.sum(c).alias(c) for c in ("n", "e", "a", "b", "aa", "bb", "ab")])
    top = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    under = F.sqrt((F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n")))
    sums = sums.withColumns({"mae": F.when(F.col("n") > 0, F.col("e") / F.col("n")), "r": F.when(under > 1e-12, top / under)})
    of = lambda m, c: F.max(F.when(F.col("map") == m, F.col(c)))
    out = sums.groupBy("k").agg(*[of(m, c).alias(f"{m}_{c}") for m in ("probability", "spread") for c in ("mae", "r")], of("probability", "n").alias("cells"))
    named = reals.sparkSession.createDataFrame([(k, n, d) for k, (n, d) in enumerate(keys)], "k int, size int, draw int")
    return named.join(out, "k").select("size", "draw", "probability_mae", "probability_r", "spread_mae", "spread_r", "cells")


def with_guess(df: DataFrame, classes: list[int], share: str = "share_{}") -> DataFrame:
    """Adds ``guess``, the class of the largest share (of equal ones the first), and ``uncertainty``, the entropy of the shares, 0 to 1."""
    shares = [F.col(share.format(c)) for c in classes]
    guess = F.lit(classes[-1])
    for c, s in reversed(list(zip(classes[:-1], shares[:-1], strict=True))):
        guess = F.when(s >= F.greatest(*shares), c).otherwise(guess)
    return df.withColumns({"guess": guess, "uncertainty": entropy(shares)})


def confusion(df: DataFrame, truth: str = "label", guess: str = "guess") -> DataFrame:
    """Rows ``truth, guess, n`` of the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(table: DataFrame) -> DataFrame:
    """By class of a table of confusion: ``support``, precision, recall (null for a class that never occurs) and F1, 0 where undefined."""
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n"))
    of = table.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    said = table.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("said"))
    x = of.join(said, "class", "full").select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "said")])
    return x.select("class", "support", F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0).alias("precision"), F.when(F.col("support") > 0, F.col("tp") / F.col("support")).alias("recall"), (2 * F.col("tp") / (F.col("support") + F.col("said"))).alias("f1"))


def multiclass_summary(df: DataFrame, classes: list[int], truth: str = "label", share: str = "share_{}", by: list[str] | None = None) -> DataFrame:
    """One row (for each group ``by``): ``n``, accuracy, macro F1 (over classes that occur or are guessed), balanced accuracy and log loss
    (shares at least 1e-15).  Rows need ``guess``."""
    by = by or []
    own = F.lit(None).cast("double")
    for c in classes:
        own = F.when(F.col(truth) == c, F.col(share.format(c))).otherwise(own)
    counts = [f(F.col(a) == c).alias(f"{n}{c}") for c in classes for n, a, f in (("t", truth, F.count_if), ("g", "guess", F.count_if))]
    hits = [F.count_if((F.col(truth) == c) & (F.col("guess") == c)).alias(f"h{c}") for c in classes]
    x = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), *counts, *hits)
    f1 = F.array_compact(F.array(*[F.when(F.col(f"t{c}") + F.col(f"g{c}") > 0, 2 * F.col(f"h{c}") / (F.col(f"t{c}") + F.col(f"g{c}"))) for c in classes]))
    recall = F.array_compact(F.array(*[F.when(F.col(f"t{c}") > 0, F.col(f"h{c}") / F.col(f"t{c}")) for c in classes]))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))
    accuracy = F.try_divide(sum((F.col(f"h{c}") for c in classes), F.lit(0)), F.col("n"))
    return x.select(*by, "n", accuracy.alias("accuracy"), mean(f1).alias("macro_f1"), mean(recall).alias("balanced_accuracy"), "log_loss")


def area_under_curve(df: DataFrame, score: str, hit: str, by: list[str]) -> DataFrame:
    """Rows ``by, n, hits, auc``: the chance that a hit has a larger score than a miss, ties half; null without both.

    Counts by score and running sums within groups; no pairs of rows."""
    x = df.filter(_real(score) & F.col(hit).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("_s")).agg(F.count_if(F.col(hit)).alias("_h"), F.count_if(~F.col(hit)).alias("_m"))
    x = order.running_by(x, by, ["_s"], {"_below": F.col("_m")}, inclusive=False)
    out = x.groupBy(*by).agg(F.sum(F.col("_h") + F.col("_m")).alias("n"), F.sum("_h").alias("hits"), F.sum("_m").alias("_misses"), F.sum(F.col("_h") * (F.col("_below") + F.col("_m") / 2)).alias("_u"))
    return out.select(*by, "n", "hits", F.when((F.col("hits") > 0) & (F.col("_misses") > 0), F.col("_u") / F.col("hits") / F.col("_misses")).alias("auc"))


def one_against_rest(df: DataFrame, classes: list[int], truth: str = "label", share: str = "share_{}") -> DataFrame:
    """Rows ``class, n, hits, auc``: each class against all others by its share, all classes in one pass."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(share.format(c)).alias("s"), (F.col(truth) == c).alias("hit")) for c in classes]))
    return area_under_curve(df.select(rows.alias("r")).select("r.*"), "s", "hit", ["class"])


def reliability(df: DataFrame, p: str, hit: str, bins: int = 10) -> DataFrame:
    """Rows ``bin, n, mean_p, observed`` of the fixed-width bins of p that hold rows; 1 is in the last."""
    k = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(_real(p)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("observed"))


def brier(df: DataFrame, p: str, hit: str, fold: str = "fold") -> DataFrame:
    """One row: ``n``, the Brier score, that of always saying the share of hits in the other folds, and the skill over it."""
    y = F.col(hit).cast("double")
    by = df.filter(_real(p)).groupBy(F.col(fold).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(F.pow(F.col(p) - y, 2)).alias("e"))
    whole = by.agg(F.sum("n").alias("wn"), F.sum("s").alias("ws"))
    prior = F.when(F.col("wn") > F.col("n"), (F.col("ws") - F.col("s")) / (F.col("wn") - F.col("n")))
    # A fold's squared errors at one p: hits off by 1 - p, misses by p.
    at = F.col("s") * F.pow(1 - prior, 2) + (F.col("n") - F.col("s")) * F.pow(prior, 2)
    x = by.crossJoin(F.broadcast(whole)).select("n", "e", at.alias("at")).agg(F.sum("n").alias("n"), (F.sum("e") / F.sum("n")).alias("brier"), (F.sum("at") / F.sum("n")).alias("reference"))
    return x.withColumn("skill", F.when(F.col("reference") > 0, 1 - F.col("brier") / F.col("reference")))


def footprint_edge(columns: DataFrame, keys: tuple[str, str] = ("ix", "iy")) -> DataFrame:
    """Adds ``edge``: true where one of the eight neighbours is not among the rows (one-cell erosion); beyond the grid is not.

    Each column tells its neighbours that it is there, and counts meet by key."""
    a, b = keys
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    told = columns.select(a, b).distinct().select(F.col(a).alias("_a"), F.col(b).alias("_b"), steps.alias("s"))
    told = told.groupBy((F.col("_a") + F.col("s.i")).alias("_a"), (F.col("_b") + F.col("s.j")).alias("_b")).agg(F.count(F.lit(1)).alias("_near"))
    out = columns.join(told, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    return out.select(*columns.columns, (F.coalesce("_near", F.lit(0)) < 8).alias("edge"))


def plan_classes(columns: DataFrame, spread_share: float = 0.9, persistent: float = 0.8) -> DataFrame:
    """Plan columns ``ix, iy, spread, probability`` with ``high_spread`` (at or above that quantile of all spreads), ``persistent``
    (probability at least so much) and ``edge``."""
    mark = order.quantile_row(columns, "spread", {"_mark": spread_share})
    x = footprint_edge(columns).crossJoin(F.broadcast(mark))
    return x.withColumns({"high_spread": F.col("spread") >= F.col("_mark"), "persistent": F.col("probability") >= persistent}).drop("_mark")


def plan_summary(classes: DataFrame, distance: str, far: float, occupied: str) -> DataFrame:
    """By class (all, high_spread, persistent, both): columns, their share, median ``distance`` to the nearest sample, percentages beyond
    ``far`` and on the edge, percentage in the middle third by ``iy``, and mean ``occupied`` height."""
    span = classes.agg(F.min("iy").alias("_lo"), F.max("iy").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    third = F.least(F.floor(3 * (F.col("iy") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)), F.lit(2))
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("high_spread"), F.lit("high_spread")), F.when(F.col("persistent"), F.lit("persistent")), F.when(F.col("high_spread") & F.col("persistent"), F.lit("both"))))
    x = classes.crossJoin(F.broadcast(span)).withColumn("_middle", third == 1).withColumn("class", F.explode(names))
    share = lambda c: (100 * F.avg(c.cast("double")))
    return x.groupBy("class").agg(
        F.count(F.lit(1)).alias("columns"), (100 * F.count(F.lit(1)) / F.max("_n")).alias("pct"), F.median(distance).alias("median_distance"),
        share(F.col(distance) > far).alias("far_pct"), share(F.col("edge")).alias("edge_pct"), share(F.col("_middle")).alias("middle_pct"), F.avg(occupied).alias("mean_occupied"),
    )


def envelope_shares(fine: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Rows ``ix, iy, iz, share`` of coarse cells: how much of their volume the fine cells ``ix, iy, iz`` (each counted once) fill."""
    coarse = [F.floor(F.col(f"i{a}") / f).cast("long").alias(f"i{a}") for a, f in zip("xyz", factors, strict=True)]
    return fine.select("ix", "iy", "iz").distinct().select(*coarse).groupBy("ix", "iy", "iz").agg((F.count(F.lit(1)) / math.prod(factors)).alias("share"))


def envelope_means(reals: DataFrame, shares: DataFrame) -> DataFrame:
    """By realisation: the mean over the whole grid, over cells that the envelope meets, weighted by their share of it, and over cells that
    are whole in it; null where there is none."""
    s = shares.select(*[F.col(f"i{a}").alias(f"_{a}") for a in "xyz"], F.col("share"))
    x = reals.filter(_real("value")).join(s, [F.col(f"i{a}") == F.col(f"_{a}") for a in "xyz"], "left")
    v, f = F.col("value"), F.col("share")
    return x.groupBy("real_id").agg(F.avg(v).alias("whole_mean"), F.avg(F.when(f > 0, v)).alias("any_mean"), (F.sum(v * f) / F.sum(f)).alias("share_mean"), F.avg(F.when(f >= 1, v)).alias("core_mean"))


def axis_swaths(reals: DataFrame, observed: DataFrame, axes: dict[str, tuple[float, float, float]], bins: int = 10, least: int = 5) -> DataFrame:
    """Swaths along turned axes: rows ``axis, bin, samples, observed, p10, p50, p90``.

    Both tables have ``x, y, z, value``, the realisations also ``real_id``.
    Places are measured along each axis, and cut in equal bins between the
    least and the greatest of the cells; samples beyond are left out.  Each
    realisation is averaged over a bin's cells, and the percentiles are of
    these means; the samples' mean is shown only where there are ``least``.
    """
    along = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), (F.col("x") * a + F.col("y") * b + F.col("z") * c).alias("t")) for n, (a, b, c) in axes.items()]))
    cells = reals.filter(_real("value")).select("real_id", "value", along.alias("s")).select("real_id", "value", "s.*")
    seen = observed.filter(_real("value")).select("value", along.alias("s")).select("value", "s.*")
    # One row for each axis.
    ends = reals.filter(_real("value")).select(along.alias("s")).groupBy(F.col("s.axis").alias("of")).agg(F.min("s.t").alias("lo"), F.max("s.t").alias("hi"))

    def binned(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(ends), F.col("axis") == F.col("of")).filter(F.col("t").between(F.col("lo"), F.col("hi")))
        k = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0)
        return x.withColumn("bin", F.least(k, F.lit(bins - 1)).cast("int"))

    means = binned(cells).groupBy("axis", "bin", "real_id").agg(F.avg("value").alias("m"))
    curves = means.groupBy("axis", "bin").agg(*[F.percentile("m", F.lit(p)).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))])
    counts = binned(seen).groupBy(F.col("axis").alias("_axis"), F.col("bin").alias("_bin")).agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"))
    out = curves.join(counts, (F.col("axis") == F.col("_axis")) & (F.col("bin") == F.col("_bin")), "left")
    return out.select("axis", "bin", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("samples") >= least, F.col("mean")).alias("observed"), "p10", "p50", "p90")
