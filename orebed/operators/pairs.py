"""Neighbours and point pairs by blocks of space: what can't meet is left out by the blocks' boxes, the rest is compared in NumPy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored

#: Rows at most of a block of points whose pairs are made, of targets, and of samples that are searched.
PAIR_ROWS, TARGET_ROWS, SAMPLE_ROWS = 8192, 1024, 2048
#: Targets that a block of samples meets in one task, in blocks of them.
MEETING = 16
#: Blocks of samples that a block of targets meets before any others.
FIRST = 4
#: Rows of runs that are compared at once: arrays that stay in the processor's cache.
RUN_A, RUN_B = 64, 256


def _spread(q: np.ndarray) -> np.ndarray:
    """The 21 bits of each number, two places apart."""
    q = q.astype(np.uint64)
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        q = (q | (q << np.uint64(shift))) & np.uint64(mask)
    return q


def _curve(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """Place along Hilbert's curve through space, of coordinates between 0 and 1: runs along it have small boxes, as it never leaps."""
    at = [np.clip(c.to_numpy() * 2097151, 0, 2097151).astype(np.uint64) for c in (x, y, z)]
    halves = [np.uint64(1 << k) for k in range(20, 0, -1)]
    # Each half of a cell is turned and mirrored so that the curve ends where the next one begins.
    for half in halves:
        low = half - np.uint64(1)
        for c in at:
            far = (c & half) != 0
            turn = np.where(far, low, (at[0] ^ c) & low)
            at[0] ^= turn
            c ^= np.where(far, np.uint64(0), turn)
    at[1] ^= at[0]
    at[2] ^= at[1]
    odd = np.zeros_like(at[0])
    for half in halves:
        odd ^= np.where((at[2] & half) != 0, half - np.uint64(1), np.uint64(0))
    bits = [_spread(c ^ odd) for c in at]
    return pd.Series((bits[2] | (bits[1] << np.uint64(1)) | (bits[0] << np.uint64(2))).astype(np.int64))


def _placed(df: DataFrame) -> DataFrame:
    """The rows whose coordinates, as doubles, are finite numbers: no others are near anything."""
    df = df.withColumns({a: F.col(a).cast("double") for a in "xyz"})
    for a in "xyz":
        df = df.filter(F.abs(F.col(a)) < math.inf)
    return df


def _blocked(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows, written, with ``_block``: runs of at most ``most`` along a curve through space, each of one group ``by``.

    However crowded a place is, no block is larger; small tables have about 24 blocks."""
    held = stored(df, "places")
    ends = held.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{e}{a}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]).first()
    n = ends["n"]
    if n == 0:
        return held.withColumn("_block", F.lit(0).cast("long"))
    rows = min(most, max(256, -(-n // 24)))
    size = max(ends[f"hi{a}"] - ends[f"lo{a}"] for a in "xyz") or 1.0
    at = F.pandas_udf(_curve, T.LongType())(*[(F.col(a) - ends[f"lo{a}"]) / size for a in "xyz"])
    order = [*by, "_at", "x", "y", "z"]
    held = held.withColumn("_at", at).repartitionByRange(max(1, n // (16 * rows)), *order).withColumn("_part", F.spark_partition_id())
    whole, own = Window.partitionBy("_part").orderBy(*order), Window.partitionBy("_part", *by).orderBy("_at", "x", "y", "z")
    held = held.withColumn("_row", F.row_number().over(whole))
    # A block is named by its first row.
    first = F.col("_row") - (F.row_number().over(own) - 1) % rows if by else F.col("_row") - (F.col("_row") - 1) % rows
    return stored(held.withColumn("_block", F.col("_part").cast("long") * (1 << 40) + first).drop("_part", "_row", "_at"), "blocks")


def _boxes(blocked: DataFrame, by: list[str], block: str) -> DataFrame:
    """By block: the group ``by``, its rows ``n``, and the least and greatest coordinates."""
    b = blocked.groupBy(F.col("_block").alias(block), *by)
    return b.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{e}{a}") for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))])


def _gap(a: str, b: str) -> Column:
    """A little less than the distance of two boxes."""
    d = [F.greatest(F.lit(0.0), F.col(f"{a}.lo{c}") - F.col(f"{b}.hi{c}"), F.col(f"{b}.lo{c}") - F.col(f"{a}.hi{c}")) for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * (1 - 1e-9)


def _span(a: str, b: str) -> Column:
    """A little more than the greatest distance of points of two boxes."""
    d = [F.greatest(F.col(f"{a}.hi{c}") - F.col(f"{b}.lo{c}"), F.col(f"{b}.hi{c}") - F.col(f"{a}.lo{c}")) for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * (1 + 1e-9)


def _leaves(xyz: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and boxes of runs of so many rows."""
    starts = np.arange(0, len(xyz), rows)
    return starts, np.minimum.reduceat(xyz, starts), np.maximum.reduceat(xyz, starts)


def _in_order(xyz: np.ndarray) -> np.ndarray:
    """Numbers of the rows along a curve through their box."""
    low = xyz.min(0)
    unit = (xyz - low) / (float((xyz.max(0) - low).max()) or 1.0)
    return np.argsort(_curve(*(pd.Series(c) for c in unit.T)).to_numpy(), kind="stable")


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """A little less than the distance of each box of ``a`` and each of ``b``."""
    d = np.maximum(0.0, np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None]))
    return np.sqrt((d * d).sum(-1)) * (1 - 1e-9)


def _off(a: np.ndarray, b: np.ndarray, reach: float, axis: tuple[float, float, float], limit: float) -> np.ndarray:
    """Which runs of ``a`` and of ``b`` have no points that lie from each other within the cosine ``limit`` of an axis and within reach, by
    boxes along the axis: there is more across it than the angle allows."""
    frame, cosine = np.linalg.svd(np.array([axis], float))[2], min(1.0, limit / float(np.linalg.norm(axis)))
    slack = 1e-9 * max(1.0, float(np.abs(a).max()), float(np.abs(b).max()))
    (_, lo_a, hi_a), (_, lo_b, hi_b) = _leaves(a @ frame.T, RUN_A), _leaves(b @ frame.T, RUN_B)
    along = np.minimum(np.maximum(hi_a[:, None, 0] - lo_b[None, :, 0], hi_b[None, :, 0] - lo_a[:, None, 0]), reach)
    across = _apart(lo_a[:, 1:], hi_a[:, 1:], lo_b[:, 1:], hi_b[:, 1:])
    return across > along * (math.sqrt(1 - cosine * cosine) / cosine) * (1 + 1e-6) + slack


def _distances(a: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Differences along each axis, and distances, of each row of ``b`` from each of ``a``."""
    d = [b[None, :, k] - a[:, None, k] for k in range(3)]
    h = d[0] * d[0]
    h += d[1] * d[1]
    h += d[2] * d[2]
    return d, np.sqrt(h, out=h)


def _nearest(t: np.ndarray, fold_t: np.ndarray | None, s: np.ndarray, fold_s: np.ndarray | None, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of targets and of samples, and distances, of the k nearest samples no farther than ``far`` of each target, equal distances by
    the number of the sample.  Runs of targets first meet the runs of samples nearest to them, then all that can be nearer."""
    order_t, order_s = _in_order(t), _in_order(s)
    starts_t, lo_t, hi_t = _leaves(t[order_t], 32)
    starts_s, lo_s, hi_s = _leaves(s[order_s], 64)
    out = []
    for i, start in enumerate(starts_t):
        rows = order_t[start : start + 32]
        apart = _apart(lo_t[i : i + 1], hi_t[i : i + 1], lo_s, hi_s)[0]
        near = np.argsort(apart, kind="stable")
        most = float(far[rows].max())
        near = near[apart[near] <= most]
        used = min(4, len(near))
        while used:
            places = (starts_s[near[:used], None] + np.arange(64)).ravel()
            columns = np.sort(order_s[places[places < len(s)]])
            h = _distances(t[rows], s[columns])[1]
            if fold_t is not None:
                h[fold_t[rows][:, None] == fold_s[columns][None]] = math.inf
            kth = np.partition(h, k - 1, axis=1)[:, k - 1] if len(columns) >= k else np.full(len(rows), math.inf)
            wanted = int(np.searchsorted(apart[near], min(float(kth.max()), most), "right"))
            if wanted <= used:
                a, b = np.nonzero((h <= kth[:, None]) & (h <= far[rows][:, None]))
                order = np.lexsort((b, h[a, b], a))
                a, b = a[order], b[order]
                rank = np.arange(len(a)) - np.searchsorted(a, a)
                a, b = a[rank < k], b[rank < k]
                out.append((rows[a], columns[b], h[a, b]))
                break
            used = min(wanted, 2 * used) if math.isinf(kth.max()) else wanted
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def neighbours(targets: DataFrame, samples: DataFrame, radius: float, k: int, apart: str | None = None, within: str | None = None) -> DataFrame:
    """The k nearest samples (``id, x, y, z, label``) within the radius of each target (``id, x, y, z``);
    equal distances by sample id.

    With ``apart``, a column of both, only samples that differ from the target in
    it count (for a fold, those of all others), with ``within`` only those that
    are equal in it, and a target is an id of one ``within``.

    Targets of one place ask once.  Of the samples of one place (and fold) only
    the k of least id can be among anyone's nearest.  Both are cut in blocks
    along a curve through space.  Counts by block and fold bound how far the kth
    nearest of any target of a block lies, and the FIRST blocks tell each target
    how far its own lies at most.  With that a target goes to the few further
    blocks of samples whose boxes it reaches, alone: samples are not sent to
    every block of targets near them, so what is moved grows with the rows.
    """
    own, same = [c for c in (apart, within) if c], [within] if within else []
    place = [*own, "x", "y", "z"]
    asked = _placed(targets.select("id", "x", "y", "z", *own)).dropna(subset=own or ["x"])
    held = _placed(samples.select("id", "x", "y", "z", "label", *own)).dropna(subset=own or ["x"])
    held = held.withColumn("_copy", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).filter(F.col("_copy") <= k).drop("_copy")
    t = _blocked(asked.select(*place).distinct().withColumn("_ask", F.monotonically_increasing_id()), same, TARGET_ROWS)
    s = _blocked(held, same, SAMPLE_ROWS)
    a, b = _boxes(t, same, "_t").alias("a"), _boxes(s, same, "_s").alias("b")
    near = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same] + [_gap("a", "b") <= radius]) if same else a.crossJoin(b).filter(_gap("a", "b") <= radius)
    near = near.select("_t", "_s", F.col("b.n").alias("n"), _gap("a", "b").alias("gap"), _span("a", "b").alias("span"))
    if apart:
        # What the fold that has most of a block of samples, of those in a block of targets, leaves of it.
        ft = t.select(F.col("_block").alias("_t"), F.col(apart).alias("_f")).distinct()
        fs = s.groupBy(F.col("_block").alias("_s"), F.col(apart).alias("_f")).agg(F.count(F.lit(1)).alias("m"))
        alone = ft.groupBy("_t").agg(F.count(F.lit(1)).alias("folds"))
        most = ft.join(fs, "_f").groupBy("_t", "_s").agg(F.max("m").alias("m"))
        near = near.join(alone, "_t").join(most, ["_t", "_s"], "left").withColumn("left", F.col("n") - F.coalesce("m", F.lit(0)))
        near = near.filter((F.col("folds") > 1) | (F.col("left") > 0))
    else:
        near = near.withColumn("left", F.col("n"))
    near = stored(near.select("_t", "_s", "n", "gap", "span", "left"), "meetings")
    upto = F.sum("left").over(Window.partitionBy("_t").orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    bound = near.withColumn("upto", upto).filter(F.col("upto") >= k).groupBy("_t").agg(F.min("span").alias("bound"))
    near = near.join(bound, "_t", "left").filter(F.col("gap") <= F.coalesce("bound", F.lit(radius)))
    near = stored(near.withColumn("_turn", F.row_number().over(Window.partitionBy("_t").orderBy("span", "_s"))), "meetings")
    kinds = dict(samples.dtypes)

    def kernel(t: pa.Table, s: pa.Table) -> pa.Table:
        if not len(t) or not len(s):
            i = j = np.zeros(0, int)
            h = np.zeros(0)
        else:
            s = s.take(pc.sort_indices(s["id"]))
            folds = pa.chunked_array([*t[apart].chunks, *s[apart].chunks]).combine_chunks().dictionary_encode().indices.to_numpy() if apart else None
            places = [np.column_stack([d[c].to_numpy() for c in "xyz"]) for d in (t, s)]
            i, j, h = _nearest(places[0], folds[: len(t)] if apart else None, places[1], folds[len(t) :] if apart else None, t["_far"].to_numpy(), k)
        # A target's samples follow each other, nearest first.
        new = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(new, np.diff(new, append=len(i))) + 1
        return pa.table({"_ask": t["_ask"].take(pa.array(i)), "sample": s["id"].take(pa.array(j)), "label": s["label"].take(pa.array(j)), "distance": h, "rank": rank.astype(np.int32)})

    asks, holds = ["_ask", "_far", *([apart] if apart else []), "x", "y", "z"], ["id", "label", *([apart] if apart else []), "x", "y", "z"]

    def search(to_t: DataFrame, to_s: DataFrame, parts: int) -> DataFrame:
        """What targets find among the samples of their own ``_task`` and ``_m``."""
        to_s = to_s.withColumnsRenamed({"_task": "_of_task", "_m": "_of_m"})
        parts = max(1, min(1000, parts))
        both = to_t.repartition(parts, "_task", "_m").groupBy("_task", "_m").cogroup(to_s.repartition(parts, "_of_task", "_of_m").groupBy("_of_task", "_of_m"))
        return stored(both.applyInArrow(kernel, f"_ask long, sample {kinds['id']}, label {kinds['label']}, distance double, rank int"), "found")

    # The blocks next to it tell how far each target's kth nearest is at most; few others can be nearer.
    next_to = near.filter(F.col("_turn") <= FIRST).select(F.col("_t").alias("_task"), F.lit(0).alias("_m"), "_s")
    blocks = next_to.select("_task", "_m").distinct()
    whole = F.lit(float(radius))
    t = t.join(bound.withColumnRenamed("_t", "_b"), F.col("_block") == F.col("_b"), "left").withColumn("_far", F.least(whole, F.coalesce("bound", whole))).drop("_b", "bound")
    to_t = t.join(blocks, F.col("_block") == F.col("_task")).select("_task", "_m", *asks)
    first = search(to_t, next_to.join(s, F.col("_s") == F.col("_block")).select("_task", "_m", *holds), blocks.count())
    kth = first.filter(F.col("rank") == k).select(F.col("_ask").alias("_a"), F.col("distance").alias("_kth"))
    t = stored(t.join(kth, F.col("_ask") == F.col("_a"), "left").withColumn("_far", F.coalesce("_kth", "_far")).drop("_a", "_kth"), "targets")
    reach = t.groupBy(F.col("_block").alias("_b")).agg(F.max("_far").alias("_reach"))
    more = near.filter(F.col("_turn") > FIRST).join(reach, F.col("_t") == F.col("_b")).filter(F.col("gap") <= F.col("_reach"))
    more = more.select("_t", "_s").join(_boxes(s, [], "_of").drop("n"), F.col("_s") == F.col("_of"))
    beyond = [F.greatest(F.lit(0.0), F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}")) for c in "xyz"]
    reached = F.sqrt(beyond[0] * beyond[0] + beyond[1] * beyond[1] + beyond[2] * beyond[2]) * (1 - 1e-9) <= F.col("_far")
    sent = stored(t.join(more, F.col("_block") == F.col("_t")).filter(reached).select(F.col("_s").alias("_task"), *asks), "sent")
    tasks = stored(sent.groupBy(F.col("_task").alias("_s")).agg(F.ceil(F.count(F.lit(1)) / (MEETING * TARGET_ROWS)).cast("int").alias("_ms")), "tasks")
    to_t = sent.join(tasks, F.col("_task") == F.col("_s")).select("_task", F.pmod(F.xxhash64("_ask"), "_ms").cast("int").alias("_m"), *asks)
    to_s = tasks.join(s, F.col("_s") == F.col("_block")).select(F.col("_s").alias("_task"), F.explode(F.sequence(F.lit(0), F.col("_ms") - 1)).alias("_m"), *holds)
    found = first.unionByName(search(to_t, to_s, tasks.agg(F.sum("_ms")).first()[0] or 0)).drop("rank")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("_ask").orderBy("distance", "sample"))).filter(F.col("rank") <= k)
    to = asked.select(F.col("id").alias("target"), *place).join(t.select(F.col("_ask").alias("_a"), *place), place).drop("x", "y", "z")
    return to.join(found, F.col("_a") == F.col("_ask")).select("target", "sample", "label", "distance", "rank", *same)


def search_space(df: DataFrame, radii: tuple[float, float, float], axes: tuple[tuple[float, float, float], ...] | None = None) -> DataFrame:
    """The rows with x, y and z in units of an ellipsoid's radii, along its axes: within it means within distance 1.
    Without axes the ellipsoid lies along x, y and z.  ``neighbours`` of radius 1 then search it."""
    along = [F.col(a) for a in "xyz"] if axes is None else [sum((F.col(a) * v for a, v in zip("yz", axis[1:], strict=True)), F.col("x") * axis[0]) for axis in axes]
    return df.select(*[c for c in df.columns if c not in "xyz"], *[(v / size).alias(a) for a, v, size in zip("xyz", along, radii, strict=True)])


#: Samples of a cell that a far target is compared with one by one; cells of more are halved first.
CELL_SAMPLES = 64


def nearest_anywhere(targets: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """Label and distance of the nearest sample of each target, however far; null where there are no samples.

    Targets without one within the radius go down a tree of cells, all of them
    a level at a time: of the cells that a target still has, each half-size
    part that holds samples can't be nearer than its box, and one of its
    samples is as far as it is; parts whose box lies beyond the nearest such
    sample are left out.  So a target far away meets a few cells a level, not
    all samples, and in the end those of cells with CELL_SAMPLES or fewer.
    Equal distances go by the sample's id.
    """
    places = targets.select("id", "x", "y", "z")
    tried = stored(places.join(nearest_label(places, samples, radius).withColumnRenamed("target", "id"), "id"), "nearest")
    near, left = tried.filter("distance IS NOT NULL"), tried.filter("distance IS NULL")
    ends = samples.agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if left.isEmpty() or ends["lox"] is None:
        return tried.select(F.col("id").alias("target"), "label", "distance")
    origin = {a: ends[f"lo{a}"] for a in "xyz"}
    extent = max(ends[f"hi{a}"] - ends[f"lo{a}"] for a in "xyz")
    level = max(0, math.ceil(math.log2(max(extent / radius, 1.0))))
    size = radius * 2.0**level
    deepest = max(extent, radius) * 1e-12
    held = stored(samples.select("id", "x", "y", "z", "label").dropna(subset=["x", "y", "z"]), "samples")

    def cell(a: str, at: str, width: float) -> Column:
        return F.floor((F.col(at) - origin[a]) / width).cast("long")

    def cells(width: float) -> DataFrame:
        keys = [cell(a, a, width).alias(f"c{a}") for a in "xyz"]
        return held.groupBy(*keys).agg(F.min(F.struct("id", "x", "y", "z")).alias("one"), F.count(F.lit(1)).alias("n"))

    # At most two cells along each axis.
    now = left.select(F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz")).crossJoin(F.broadcast(cells(size)))
    while True:
        beyond = [F.greatest(F.lit(0.0), origin[a] + F.col(f"c{a}") * size - F.col(f"t{a}"), F.col(f"t{a}") - origin[a] - (F.col(f"c{a}") + 1) * size) for a in "xyz"]
        least = F.sqrt(sum((b * b for b in beyond[1:]), beyond[0] * beyond[0])) * (1 - 1e-9)
        most = F.sqrt(sum((F.pow(F.col(f"one.{a}") - F.col(f"t{a}"), 2) for a in "yz"), F.pow(F.col("one.x") - F.col("tx"), 2)))
        now = stored(now.select("target", "tx", "ty", "tz", "cx", "cy", "cz", "n", least.alias("least"), most.alias("most")), "cells")
        best = now.groupBy(F.col("target").alias("of")).agg(F.min("most").alias("bound"))
        now = stored(now.join(best, F.col("target") == F.col("of")).filter("least <= bound").drop("of", "bound", "least", "most"), "cells")
        if now.agg(F.max("n")).first()[0] <= CELL_SAMPLES or size <= deepest:
            break
        size /= 2
        parts = cells(size).withColumnsRenamed({"n": "m"}).withColumns({f"p{a}": F.floor(F.col(f"c{a}") / 2).cast("long") for a in "xyz"})
        up = now.select("target", "tx", "ty", "tz", *[F.col(f"c{a}").alias(f"p{a}") for a in "xyz"])
        now = up.join(parts, ["px", "py", "pz"]).withColumnRenamed("m", "n").drop("px", "py", "pz")
    own = held.select(F.col("id").alias("sample"), "x", "y", "z", "label", *[cell(a, a, size).alias(f"c{a}") for a in "xyz"])
    met = now.join(own, ["cx", "cy", "cz"])
    distance = F.sqrt(sum((F.pow(F.col(a) - F.col(f"t{a}"), 2) for a in "yz"), F.pow(F.col("x") - F.col("tx"), 2)))
    found = met.groupBy("target").agg(F.min_by(F.struct("label", distance.alias("distance")), F.struct(distance.alias("d"), "sample")).alias("b")).select("target", "b.*")
    return near.select(F.col("id").alias("target"), "label", "distance").unionByName(found)


def local_shares(targets: DataFrame, samples: DataFrame, radius: float, k: int, prior_weight: float, waste: int | None, classes: list[int], apart: str | None = None) -> DataFrame:
    """For each target the share of each class.

    Inverse distances (at least 1e-6) of its neighbours are summed by class;
    a class with any gets its overall share times ``prior_weight`` besides, and
    the waste class gets ``nearest / radius * prior_weight``.  A target with
    no neighbour is all waste, or of all classes alike where there is no waste
    class.  With ``apart`` (a fold, in both) a target sees neighbours and
    overall shares of the other folds alone, and ``supported`` says whether it
    has a neighbour.
    """
    near = neighbours(targets, samples, radius, k, apart)
    one = lambda c: (F.col("label") == c).cast("double")
    own = [] if apart is None else [apart]
    counts = samples.groupBy(*own).agg(F.count("label").alias("_n"), *[F.sum(one(c)).alias(f"_s{c}") for c in classes])
    whole = counts.agg(F.sum("_n").alias("_wn"), *[F.sum(f"_s{c}").alias(f"_w{c}") for c in classes])
    if apart is None:
        prior = whole.select(*[(F.col(f"_w{c}") / F.col("_wn")).alias(f"_p{c}") for c in classes])
    else:
        left = F.col("_wn") - F.col("_n")
        prior = counts.crossJoin(F.broadcast(whole)).select(F.col(apart).alias("_fold"), *[F.when(left > 0, (F.col(f"_w{c}") - F.col(f"_s{c}")) / left).alias(f"_p{c}") for c in classes])
    sums = near.groupBy("target").agg(F.min("distance").alias("_nearest"), *[F.sum(F.when(F.col("label") == c, 1 / F.greatest("distance", F.lit(1e-6)))).alias(f"_w{c}") for c in classes])
    x = targets.select(F.col("id").alias("target"), *own).join(sums, "target", "left")
    x = x.crossJoin(F.broadcast(prior)) if apart is None else x.join(prior, F.col(apart).eqNullSafe(F.col("_fold")), "left")
    raw = {}
    for c in classes:
        w = F.coalesce(F.col(f"_w{c}") + F.coalesce(F.col(f"_p{c}"), F.lit(0.0)) * prior_weight, F.lit(0.0))
        if c == waste:
            w = w + F.coalesce(F.col("_nearest") / radius * prior_weight, F.lit(1.0))
        raw[c] = w if waste is not None else F.when(F.col("_nearest").isNull(), 1.0).otherwise(w)
    x = x.withColumns({f"_r{c}": w for c, w in raw.items()})
    total = sum((F.col(f"_r{c}") for c in classes[1:]), F.col(f"_r{classes[0]}"))
    extra = [] if apart is None else [F.col("_nearest").isNotNull().alias("supported")]
    return x.select("target", *[(F.col(f"_r{c}") / total).alias(f"share_{c}") for c in classes], *extra)


def nearest_label(targets: DataFrame, samples: DataFrame, radius: float) -> DataFrame:
    """Label of the nearest sample within the radius, null without one."""
    best = neighbours(targets, samples, radius, 1).select("target", "label", "distance")
    return targets.select(F.col("id").alias("target")).join(best, "target", "left")


def _met(a: np.ndarray, b: np.ndarray, same: bool, reach: float, least_distance: float, cones: list[tuple] | None = None) -> Iterator[tuple]:
    """Pairs of the rows of two blocks (or each pair of one once), some ten thousand at a time: ranges of rows of both, differences along
    each axis, distances, and which of them lie within reach.  Runs whose boxes lie farther apart are left out, and with ``cones`` (axis
    and cosine) those that can't have a pair within any of them."""
    starts_a, lo_a, hi_a = _leaves(a, RUN_A)
    starts_b, lo_b, hi_b = _leaves(b, RUN_B)
    near = _apart(lo_a, hi_a, lo_b, hi_b) < reach
    if cones:
        near &= ~np.logical_and.reduce([_off(a, b, reach, *c) for c in cones])
    for i, j in np.argwhere(near):
        left, right = slice(starts_a[i], starts_a[i] + RUN_A), slice(starts_b[j], starts_b[j] + RUN_B)
        if same and starts_b[j] + RUN_B <= starts_a[i]:
            continue
        d, h = _distances(a[left], b[right])
        ok = (h < reach) & (h > 0)
        if least_distance > 0:
            ok &= h >= least_distance
        if same:
            ok &= (np.arange(len(b))[right])[None] > (np.arange(len(a))[left])[:, None]
        if ok.any():
            yield left, right, d, h, ok


def _pair_jobs(points: DataFrame, reach: float, value: str | None, one_in: int, seed: int, by: tuple[str, ...], kernel, schema: str) -> DataFrame:
    """``kernel`` over all pairs of blocks within reach, whose results carry ``by``.

    Rows of one place (group and class) are one row with their number ``n``, how many have a value (``m``), its mean and squared
    deviations; a pair of places then stands for all pairs of their rows, and rows of one place make none, being 0 apart."""
    number = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") if one_in > 1 else F.lit(0)
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    v = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    rows = _placed(points.filter(F.col("id").isNotNull()).select(*by, "x", "y", "z", group.alias("_g"), F.pmod(number, F.lit(one_in)).cast("int").alias("_class"), v.alias("_v")))
    zero = F.lit(0.0)
    sums = [F.count(F.lit(1)).alias("n"), F.count("_v").alias("m"), F.coalesce(F.avg("_v"), zero).alias("mean"), F.coalesce(F.var_pop("_v") * F.count("_v"), zero).alias("dev")]
    places = _blocked(rows.groupBy("_g", "_class", "x", "y", "z").agg(*sums), ["_g", "_class"], PAIR_ROWS)
    a, b = _boxes(places, ["_g", "_class"], "_a").alias("a"), _boxes(places, ["_g", "_class"], "_b").alias("b")
    first = (F.col("a._class") < F.col("b._class")) | ((F.col("a._class") == F.col("b._class")) & (F.col("_a") <= F.col("_b")))
    on = (F.col("a._g") == F.col("b._g")) & first & ((F.col("a._class") + F.col("b._class")) % one_in == 0) & (_gap("a", "b") < reach)
    jobs = stored(a.join(b, on).select(F.col("a._g").alias("_g"), "_a", "_b"), "jobs")
    plain = places.drop("_g", "_class")
    sent = [jobs.join(plain, F.col(c) == F.col("_block")).withColumn("_side", F.lit(k)) for k, c in enumerate(("_a", "_b"))]
    sent = sent[0].unionByName(sent[1].filter("_a <> _b")).drop("_block")

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return kernel(*[group[group["_side"] == k] for k in (0, 1)]).assign(_of=np.int64(key[0]))

    done = sent.repartition(max(1, min(1000, jobs.count())), "_a", "_b").groupBy("_a", "_b").applyInPandas(run, f"{schema}, _of long")
    if not by:
        return done.drop("_of")
    named = rows.select("_g", *by).dropDuplicates(["_g"])
    return done.join(jobs.select(F.col("_a").alias("_of"), "_g").distinct(), "_of").join(named, "_g").drop("_g", "_of")


def _sides(a: pd.DataFrame, b: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """Both blocks along a curve; a block that meets itself comes alone."""
    a, b = (d if not len(d) else d.iloc[_in_order(d[["x", "y", "z"]].to_numpy(float))] for d in (a, b))
    return (a, b, False) if len(b) else (a, a, True)


def _dot(axis: tuple[float, float, float], d: list[np.ndarray]) -> np.ndarray:
    x, y, z = axis
    return np.abs(d[0] * x + d[1] * y + d[2] * z)


def _named(names: list[str]) -> Column:
    """The direction of number ``_d``."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_d") + 1).alias("direction")


def variogram(points: DataFrame, reach: float, lags: int, directions: dict[str, tuple[float, float, float]], tolerance: float | dict[str, float], least_distance: float = 0.0, value: str = "value", one_in: int = 1, seed: int = 1337, by: tuple[str, ...] = ()) -> DataFrame:
    """By direction and lag: pairs, mean distance, half the mean squared difference.

    Each pair of points (of ids of their own) within reach counts once, in each
    direction whose axis it lies within ``tolerance`` degrees of (one number, or
    one for each direction; 90 takes every pair); a pair at ``reach`` itself is
    out.  Pairs meet only within groups of equal ``by`` (realisations, domains),
    all of which one job serves.  With ``one_in`` above 1 a seeded sample of
    the pairs counts, about one in so many: points are dealt into classes by a
    digest of their id, and a class meets only the one with which its number
    adds up to 0.  Other pairs are never made.

    Every pair of places within reach and within a direction's angle is made, as the mean distance needs each; where all directions have
    an angle, runs of places that lie off all of them are left out by their boxes:
    blocks of PAIR_ROWS places meet, two a group, and only sums by lag leave it.
    """
    names, width = list(directions), reach / lags
    limits = {n: math.cos(math.radians(t)) if t < 90 else None for n, t in ((n, tolerance[n] if isinstance(tolerance, dict) else tolerance) for n in names)}

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(a, b)
        xa, xb = (d[["x", "y", "z"]].to_numpy(float) for d in (a, b))
        (na, ma, va, da), (nb, mb, vb, db) = ([d[c].to_numpy(float) for c in ("n", "m", "mean", "dev")] for d in (a, b))
        single = all((c == 1).all() for c in (na, ma, nb, mb))
        sums = np.zeros((len(names), 4, lags + 1))
        slack = 1e-12 * max(1.0, float(np.abs(xa).max()), float(np.abs(xb).max()))
        along = {n: (xa @ np.array(directions[n], float), xb @ np.array(directions[n], float)) for n in names if limits[n] is not None}
        cones = [(directions[n], limits[n]) for n in names] if all(limits[n] is not None for n in names) else None
        for left, right, d, h, ok in _met(xa, xb, same, reach, least_distance, cones):
            for k, name in enumerate(names):
                if limits[name] is None:
                    at = np.flatnonzero(ok)
                else:
                    # Rows along the axis tell most pairs apart; those that are left are looked at exactly.
                    apart = along[name][1][right][None] - along[name][0][left][:, None]
                    at = np.flatnonzero(ok & (np.abs(apart, out=apart) >= h * (limits[name] - 1e-6) - slack))
                    at = at[_dot(directions[name], [c.ravel()[at] for c in d]) / h.ravel()[at] >= limits[name]]
                if not len(at):
                    continue
                far = h.ravel()[at]
                bins = (far / width).astype(np.int64)
                i, j = np.divmod(at, h.shape[1])
                i, j = i + left.start, j + right.start
                half = va[i] - vb[j]
                half *= half
                if single:
                    pairs = valued = np.bincount(bins, minlength=lags + 1)
                else:
                    many = na[i] * nb[j]
                    pairs, valued = (np.bincount(bins, w, lags + 1) for w in (many, ma[i] * mb[j]))
                    half, far = ma[i] * mb[j] * half + mb[j] * da[i] + ma[i] * db[j], far * many
                sums[k] += pairs, valued, np.bincount(bins, far, lags + 1), np.bincount(bins, half, lags + 1) / 2
        k, lag = np.nonzero(sums[:, 0])
        return pd.DataFrame({"_d": k, "lag": lag, **{c: sums[k, x, lag] for x, c in enumerate(("_pairs", "_valued", "_far", "_half"))}})

    p = _pair_jobs(points, reach, value, one_in, seed, by, kernel, "_d int, lag int, _pairs double, _valued double, _far double, _half double")
    p = p.groupBy(*by, _named(names), "lag").agg(*[F.sum(c).alias(c) for c in ("_pairs", "_valued", "_far", "_half")])
    return p.select(*by, "direction", "lag", F.col("_pairs").cast("long").alias("pairs"), (F.col("_far") / F.col("_pairs")).alias("distance"), F.try_divide("_half", "_valued").alias("gamma"))


def _last_cosine(k: int, step: int) -> float:
    """The greatest cosine whose angle in degrees is ``k`` steps or more."""
    lo, hi = 0.0, 1.0
    while (mid := (lo + hi) / 2) not in (lo, hi):
        if np.degrees(np.arccos(mid)) / step >= k:
            lo = mid
        else:
            hi = mid
    return lo


def pair_funnel(points: DataFrame, reach: float, directions: dict[str, tuple[float, float, float]], tolerance: float, least_distance: float = 0.0, step: int = 5, one_in: int = 1, seed: int = 1337, by: tuple[str, ...] = ()) -> DataFrame:
    """What becomes of the pairs, by direction: ``points``, ``possible`` pairs, those ``within`` reach, those
    ``accepted`` by the angle, and ``angles``, the number of pairs within reach in each ``step`` degrees off the axis.

    One pass over the pairs, by blocks as ``variogram`` makes them."""
    names, steps, limit = list(directions), len(range(0, 90, step)), math.cos(math.radians(tolerance))
    marks = [_last_cosine(k, step) for k in range(1, steps)]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b, same = _sides(a, b)
        na, nb = a["n"].to_numpy(float), b["n"].to_numpy(float)
        single = (na == 1).all() and (nb == 1).all()
        sums = np.zeros((len(names), steps + 1))
        for left, right, d, h, ok in _met(a[["x", "y", "z"]].to_numpy(float), b[["x", "y", "z"]].to_numpy(float), same, reach, least_distance):
            at = np.flatnonzero(ok)
            d, h = [c.ravel()[at] for c in d], h.ravel()[at]
            if single:
                of = np.count_nonzero
            else:
                many = (na[left][:, None] * nb[right][None]).ravel()[at]
                of = lambda which, many=many: many[which].sum()
            whole = len(at) if single else many.sum()
            for k, name in enumerate(names):
                cosine = _dot(directions[name], d) / h
                # How many are so far off the axis or farther, from one step to the next.
                beyond = np.array([whole, *[of(cosine <= m) for m in marks], 0.0], float)
                sums[k, :steps] += beyond[:-1] - beyond[1:]
                sums[k, steps] += of(cosine >= limit)
        return pd.DataFrame({"_d": range(len(names)), "_accepted": sums[:, steps], **{f"_{k}": sums[:, k] for k in range(steps)}})

    counts = ["_accepted", *[f"_{k}" for k in range(steps)]]
    p = _pair_jobs(points, reach, None, one_in, seed, by, kernel, "_d int, " + ", ".join(f"{c} double" for c in counts))
    n = points.groupBy(*by).agg(F.count(F.lit(1)).alias("points")).select(*by, "points", (F.col("points") * (F.col("points") - 1) / 2).cast("long").alias("possible"))
    sums = p.groupBy(*by, _named(names)).agg(*[F.sum(c).cast("long").alias(c) for c in counts]).withColumn("_within", sum((F.col(c) for c in counts[2:]), F.col(counts[1])))
    every = n.withColumn("direction", F.explode(F.array(*[F.lit(d) for d in directions])))
    sums = sums.withColumnsRenamed({c: f"_{c}" for c in by})
    on = [every["direction"] == sums["direction"], *[every[c].eqNullSafe(sums[f"_{c}"]) for c in by]]
    zero = F.lit(0).cast("long")
    return every.join(sums, on, "left").select(*by, every["direction"], "points", "possible", *[F.coalesce(f"_{c}", zero).alias(c) for c in ("within", "accepted")], F.array(*[F.coalesce(f"_{k}", zero) for k in range(steps)]).alias("angles"))


def lag_shares(v: DataFrame) -> DataFrame:
    """Percent of a direction's pairs in each lag."""
    return v.withColumn("pct", 100 * F.col("pairs") / F.sum("pairs").over(Window.partitionBy("direction")))
