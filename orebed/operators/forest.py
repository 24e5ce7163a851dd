"""Random forests over counted rows: the forests of all folds grow together, a level of every tree in each round.

Numbers become bins and equal rows one row with their number, so a fold's rows are as many as its combinations of
bins, categories and labels, and no more than were given.  A tree draws for such a row what its single rows would
draw together: a Poisson number with their count for mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import order

#: Bins of a number, counted rows in one block, trees whose counts are handed on at a time.
BINS = 32
BLOCK_ROWS = 1 << 16
TREES_OUT = 25


def edges(x: DataFrame, numbers: list[str], medians: list[list[float]], bins: int = BINS) -> list[list[list[float]]]:
    """For each fold and number, the values between its bins, from the rows of the other folds (``fold``), medians where one is missing.

    Numbers with few values have a bin for each, others bins of equal ranks, exactly; what lies between two bins is halved.
    """
    values = F.array(*[F.struct(F.lit(j).alias("feature"), F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias("v")) for j, c in enumerate(numbers)])
    each = x.select("fold", F.explode(values).alias("s")).groupBy("fold", "s.feature", "s.v").agg(F.count(F.lit(1)).alias("n"))
    fill = x.sparkSession.createDataFrame([(f, j, float(m)) for f, row in enumerate(medians) for j, m in enumerate(row)], "of int, feature int, median double")
    seen = each.join(F.broadcast(fill), "feature").filter(F.col("of") != F.col("fold"))
    seen = seen.groupBy("of", "feature", F.coalesce("v", "median").alias("v")).agg(F.sum("n").alias("n"))
    at = order.running_by(seen, ["of", "feature"], ["v"], {"below": F.col("n"), "at": F.lit(1)}, inclusive=False)
    b = F.when(F.col("at_total") <= bins, F.col("at")).otherwise(F.floor(F.col("below") * bins / F.col("below_total")))
    out: list[list[list[float]]] = [[[] for _ in numbers] for _ in medians]
    last: dict[tuple[int, int], float] = {}
    for r in sorted(at.groupBy("of", "feature", b.alias("b")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: (r["of"], r["feature"], r["b"])):
        key = (r["of"], r["feature"])
        if key in last:
            mid = (last[key] + r["lo"]) / 2
            out[key[0]][key[1]].append(mid if last[key] <= mid < r["lo"] else last[key])
        last[key] = r["hi"]
    return out


@dataclass
class Layout:
    """What a fold's features are made of: the column of each, and the category that it asks for (-1: a number's bin)."""

    column: np.ndarray
    category: np.ndarray

    @staticmethod
    def of(numbers: int, sizes: list[int]) -> Layout:
        pairs = [(j, -1) for j in range(numbers)] + [(numbers + i, c) for i, s in enumerate(sizes) for c in range(s)]
        return Layout(*np.array(pairs, dtype=np.int64).reshape(-1, 2).T)

    def value(self, m: np.ndarray, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        v, asked = m[rows, self.column[feature]], self.category[feature]
        return np.where(asked < 0, v, v == asked)


@dataclass
class Forests:
    """By fold, tree and node (a node's children are 2n+1 and 2n+2): the feature that it splits on (-1: none), the last bin on
    its left and the share of label 1 there.  As large as folds, trees and depth make it, whatever the rows."""

    layouts: list[Layout]
    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray

    def node(self, fold: int, tree: int, m: np.ndarray, levels: int) -> np.ndarray:
        at, rows = np.zeros(len(m), dtype=np.int64), np.arange(len(m))
        for _ in range(levels):
            f = self.feature[fold, tree, at]
            right = self.layouts[fold].value(m, rows, np.maximum(f, 0)) > self.cut[fold, tree, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at


def _chosen(seed: int, fold: int, tree: int, level: int, features: int, some: int) -> np.ndarray:
    """The features that each node of a level may split on."""
    return np.argsort(np.random.default_rng([seed, fold, tree, level]).random((1 << level, features)), axis=1)[:, :some]


def _units(rows: DataFrame, columns: list[str], trees: int) -> DataFrame:
    """Counted rows in sorted blocks of bounded size, by hash, written once; where blocks are few, a block comes once for each share of the trees."""
    folds = [r["n"] for r in rows.groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()]
    blocks, tasks = max(1, -(-max(folds, default=0) // BLOCK_ROWS)), 4 * rows.sparkSession.sparkContext.defaultParallelism
    shares = min(trees, -(-tasks // (blocks * max(1, len(folds)))))
    size = -(-trees // shares)
    parts = rows.withColumn("block", F.pmod(F.xxhash64(*columns, "label"), F.lit(blocks)).cast("int"))
    parts = parts.groupBy("of", "block").agg(F.sort_array(F.collect_list(F.struct(*columns, "label", "n"))).alias("rows"))
    parts = parts.select("of", "block", *[F.col(f"rows.{c}").alias(c) for c in [*columns, "label", "n"]])
    parts = parts.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(trees - 1), F.lit(size)))).withColumn("until", F.least(F.col("first") + size, F.lit(trees)))
    return stored(parts.repartition(max(tasks, blocks * len(folds))), "blocks")


def grow(rows: DataFrame, columns: list[str], layouts: list[Layout], trees: int, depth: int, seed: int) -> Forests:
    """The forests of all folds on rows ``of, *columns, label, n``: bins and categories, label 0 or 1, and their number.

    Trees split by Gini impurity on the root of the number of features, drawn for each node, and end where no split
    of those parts the labels better.  Each round counts labels by tree, node, feature and bin; the best splits come back.
    """
    units = _units(rows, columns, trees)
    nodes = (2 << depth) - 1
    made = Forests(layouts, np.full((len(layouts), trees, nodes), -1, dtype=np.int32), np.zeros((len(layouts), trees, nodes), dtype=np.int32), np.full((len(layouts), trees, nodes), np.nan))

    def counts(level: int):
        start = (1 << level) - 1

        def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for u in batch.to_dict("records"):
                    fold, m = u["of"], np.stack([np.asarray(u[c], dtype=np.int64) for c in columns], axis=1)
                    label, n = np.asarray(u["label"]), np.asarray(u["n"], dtype=np.float64)
                    layout = layouts[fold]
                    some = len(layout.column) if trees == 1 else int(np.ceil(np.sqrt(len(layout.column))))
                    out = []
                    for tree in range(u["first"], u["until"]):
                        drawn = np.random.default_rng([seed, fold, tree, u["block"]]).poisson(n)
                        at = made.node(fold, tree, m, level) - start
                        here = np.flatnonzero((at >= 0) & (drawn > 0))
                        if len(here):
                            pick = _chosen(seed, fold, tree, level, len(layout.column), some)
                            value = layout.value(m, here[:, None], pick[at[here]])
                            cell = ((at[here][:, None] * some + np.arange(some)) * BINS + value).ravel()
                            w = np.repeat(drawn[here], some)
                            total = np.bincount(cell, w)
                            ones = np.bincount(cell, w * np.repeat(label[here], some), len(total))
                            hit = np.flatnonzero(total)
                            node = hit // (some * BINS)
                            out.append(pd.DataFrame({"of": fold, "tree": tree, "node": node + start, "feature": pick[node, hit // BINS % some], "bin": hit % BINS, "zeros": total[hit] - ones[hit], "ones": ones[hit]}))
                        if len(out) == TREES_OUT:
                            yield pd.concat(out)
                            out = []
                    if out:
                        yield pd.concat(out)

        return kernel

    cell = ["of", "tree", "node", "feature"]
    whole = Window.partitionBy(*cell)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for level in range(depth):
        found = units.mapInPandas(counts(level), "of int, tree int, node int, feature int, bin int, zeros double, ones double")
        found = found.groupBy(*cell, "bin").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
        found = found.select(*cell, "bin", *[F.sum(c).over(w).alias(f"{side}{c}") for c in ("zeros", "ones") for side, w in (("l", upto), ("t", whole))])
        l0, l1, r0, r1 = F.col("lzeros"), F.col("lones"), F.col("tzeros") - F.col("lzeros"), F.col("tones") - F.col("lones")
        # The fall in impurity but for a factor that all splits of a node share: no rounding can make one of nothing.
        gain = F.coalesce(F.try_divide((l0 * r1 - l1 * r0) * (l0 * r1 - l1 * r0), (l0 + l1) * (r0 + r1)), F.lit(0.0))
        best = F.max(F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lzeros", "lones", "tzeros", "tones")).alias("s")
        got = found.groupBy("of", "tree", "node").agg(best).select("of", "tree", "node", "s.*").toArrow()
        g = {c: got[c].to_numpy() for c in got.column_names}
        made.share[g["of"], g["tree"], g["node"]] = g["tones"] / (g["tzeros"] + g["tones"])
        g = {c: v[g["gain"] > 0] for c, v in g.items()}
        here = g["of"], g["tree"], g["node"]
        made.feature[here], made.cut[here] = -g["f"], -g["b"]
        for side, zeros, ones in ((1, g["lzeros"], g["lones"]), (2, g["tzeros"] - g["lzeros"], g["tones"] - g["lones"])):
            made.share[g["of"], g["tree"], 2 * g["node"] + side] = ones / (zeros + ones)
        if not len(g["of"]):
            break
    # As MLlib does: a split whose two leaves answer alike is none.
    for level in reversed(range(depth)):
        node = np.arange((1 << level) - 1, (2 << level) - 1)
        left, right = 2 * node + 1, 2 * node + 2
        alike = (made.feature[..., left] < 0) & (made.feature[..., right] < 0) & ((made.share[..., left] > 0.5) == (made.share[..., right] > 0.5))
        made.feature[..., node] = np.where(alike, -1, made.feature[..., node])
    return made


def shares(rows: DataFrame, columns: list[str], forests: Forests) -> DataFrame:
    """The rows with ``p``, the mean over their fold's trees of the share of label 1 where they end; trees that drew no row have no say."""
    trees, depth = forests.feature.shape[1], int(np.log2(forests.feature.shape[2] + 1)) - 1

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.full(len(batch), np.nan)
            for fold, part in batch.reset_index(drop=True).groupby("of"):
                m = part[columns].to_numpy(dtype=np.int64)
                votes = np.zeros((2, len(m)))
                for t in range(trees):
                    p = forests.share[fold, t, forests.node(fold, t, m, depth)]
                    votes += np.where(np.isnan(p), 0.0, p), ~np.isnan(p)
                out[part.index] = np.divide(votes[0], votes[1], out=np.full(len(m), 0.5), where=votes[1] > 0)
            yield batch.assign(p=out)

    return rows.mapInPandas(kernel, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", p double")
