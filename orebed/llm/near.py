"""Near-duplicates by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, pick, stored, table
from .components import components
from .words import Words, mix, runs, slices

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Low bits of each minimum that a signature keeps.
LOW_BITS = 4
#: Standard deviations by which an estimate may fall short of the threshold and be confirmed still.
MARGIN = 5.0
#: Members of a bucket that one block compares at most; larger buckets are compared block by block.
BLOCK = 4096
#: ... and shingles of them.
BLOCK_ITEMS = 4_000_000
#: In buckets of more members what is left is confirmed where it is compared, and gives links, not pairs.
LARGE = 64

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND_KEYS = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANES = np.uint64(0x1111111111111111)

SIGNED = "doc_id long, n long, f0 long, f1 long, bands array<long>, bits binary"


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a text of fewer words is one shingle."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = runs(h, SHINGLE)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(g[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(runs(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (64 bits each) and packed low bits of the minima of sets that aren't empty."""
    offsets = np.cumsum([0, *map(len, sets)])[:-1]
    s = np.concatenate(sets)
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    minima = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], offsets)
    by_band = minima.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
    bands = mix((mix(by_band) * _BAND_KEYS).sum(axis=2, dtype=np.uint64))
    # The minimum's own low bits carry the multiplier's parity: they are mixed first.
    low = (mix(minima.astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
    return bands, low[:, 0::2] | (low[:, 1::2] << 4)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            sets = list(shingle_sets(texts[a:b]))
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            bits: list = [None] * len(sets)
            if full:
                keys, low = signatures([sets[i] for i in full])
                for j, i in enumerate(full):
                    bands[i], bits[i] = keys[j].view(np.int64), low[j].tobytes()
            f0 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            f1 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(map(len, sets), pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n", "f0", "f1", "bands", "bits"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            sets = [s.view(np.int64) for s in shingle_sets(texts[a:b])]
            yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["node", "items"])


def estimated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from the equal lanes of packed signatures, corrected for lanes equal by chance."""
    z = x ^ y
    z |= z >> np.uint64(1)
    z |= z >> np.uint64(2)
    equal = HASHES - np.bitwise_count(z & _LANES).sum(axis=1, dtype=np.int64)
    chance = 2.0**-LOW_BITS
    return (equal / HASHES - chance) / (1 - chance)


def _least(percent: int) -> float:
    """The lowest estimate that does not rule out a link."""
    chance = 2.0**-LOW_BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - MARGIN * np.sqrt(p * (1 - p) / HASHES) / (1 - chance)


def _candidates(held: pa.Table, percent: int, least: float) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of the same block, not in one component yet, that sizes and estimate don't
    rule out.  A pair is met in its first common band alone."""
    cols = {c: held.column(c).to_numpy() for c in ("key", "block", "node", "component", "n", "band", "chunk")}
    bits = np.frombuffer(b"".join(held.column("bits").to_pylist()), np.uint64).reshape(held.num_rows, -1)
    bands = np.stack(held.column("bands").to_numpy()).astype(np.uint32)
    new = np.flatnonzero((np.diff(cols["key"], prepend=cols["key"][0] - 1) != 0) | (np.diff(cols["block"], prepend=-1) != 0))
    end = np.repeat(np.append(new[1:], held.num_rows), np.diff(np.append(new, held.num_rows)))
    whole = cols["block"] % 2 == 0  # a chunk with itself; else two chunks, of which only cross pairs count
    n, at, d = cols["n"], np.arange(held.num_rows), 0
    out = []
    while True:
        d += 1
        at = at[at + d < end[at]]
        if not len(at):
            break
        other = at + d
        small, large = np.minimum(n[at], n[other]), np.maximum(n[at], n[other])
        ok = (cols["component"][at] != cols["component"][other]) & (100 * small >= percent * large) & (whole[at] | (cols["chunk"][at] != cols["chunk"][other]))
        a, b = at[ok], other[ok]
        est = estimated(bits[a], bits[b])
        a, b, est = a[est >= least], b[est >= least], est[est >= least]
        first = np.argmax(bands[a] == bands[b], axis=1) == cols["band"][a]
        out.append((a[first], b[first], est[first]))
    a, b, est = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))
    order = np.argsort(-est, kind="stable")
    return cols, a[order], b[order], est[order]


class _Forest:
    """Union-find over the components that rows begin with."""

    def __init__(self) -> None:
        self.root: dict[int, int] = {}

    def find(self, v: int) -> int:
        root = self.root
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def join(self, u: int, v: int) -> bool:
        u, v = self.find(u), self.find(v)
        self.root[max(u, v)] = min(u, v)
        return u != v


def _edges(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _pairs(percent: int) -> Callable:
    """All candidate pairs, to be confirmed."""

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols, a, b, _ = _candidates(held, percent, _least(percent))
        return _edges(cols["node"][a], cols["node"][b])

    return _by_block(compare)


def _open(percent: int) -> Callable:
    """The rows ``key, block, node`` that have a candidate in their block."""

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols, a, b, _ = _candidates(held, percent, _least(percent))
        some = np.unique(np.concatenate([a, b])).astype(np.int64)
        return pa.record_batch([pa.array(cols[c][some], pa.int64()) for c in ("key", "block", "node")], names=["key", "block", "node"])

    return _by_block(compare)


def _likely(percent: int) -> Callable:
    """The rows ``a, b, bits_a, bits_b`` whose estimate does not rule out a link."""
    least = _least(percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_a", "bits_b"))
                ok = pa.array(estimated(x, y) >= least)
                yield pa.record_batch([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return check


def _common(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of intersections of sorted sets, given one after the other in ``values``."""
    out = np.empty(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = values[starts[i] : starts[i + 1]], values[starts[j] : starts[j + 1]]
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        out[k] = np.count_nonzero(x[at] == y)
    return out


def _confirmed(percent: int) -> Callable:
    """Links that make a spanning forest of what is linked within each block: likely pairs first,
    each confirmed on full sets unless others have joined its components before."""

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols, a, b, _ = _candidates(held, percent, _least(percent))
        items = held.column("items").combine_chunks()
        n = items.value_lengths().to_numpy()
        values, starts = items.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
        tree, of = _Forest(), cols["component"]
        out_u, out_v = [], []
        for k in range(0, len(a), 512):
            u, v = a[k : k + 512], b[k : k + 512]
            apart = np.fromiter((tree.find(p) != tree.find(q) for p, q in zip(of[u].tolist(), of[v].tolist(), strict=True)), bool, len(u))
            u, v = u[apart], v[apart]
            both = _common(values, starts, u, v)
            sure = 100 * both >= percent * (n[u] + n[v] - both)
            for p, q in zip(u[sure].tolist(), v[sure].tolist(), strict=True):
                if tree.join(int(of[p]), int(of[q])):
                    out_u.append(cols["node"][p])
                    out_v.append(cols["node"][q])
        return _edges(np.array(out_u, np.int64), np.array(out_v, np.int64))

    return _by_block(compare)


def _by_block(compare: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Calls on whole blocks of rows sorted by block, several small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, width = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            width += batch.nbytes
            if size < 8 * BLOCK and width < 64 << 20:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            key, block = t.column("key").to_numpy(), t.column("block").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield compare(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).to_batches()
            size, width = t.num_rows - cut, sum(x.nbytes for x in held)
        if held and size:
            yield compare(pa.Table.from_batches(held).combine_chunks())

    return run


def near_groups(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept``, one for each input row.

    Two documents are linked if their sets of distinct SHINGLE-word shingles
    (A-Z lower-cased; a text of fewer words is one shingle) have 100 *
    intersection >= percent * union.  ``component_id`` is the smallest id
    reachable over links; ``kept`` says whether that is the row's own.

    Rows with the same set form a class, whose smallest id stands for it.
    Of each class's minima the bands make buckets, and the low bits a packed
    signature, which estimates the similarity of pairs within a bucket.

    First every member of a bucket is compared with two of it, those with the
    smallest and the largest id: at most two pairs a member, by which most
    groups of near copies become one component.  Then what is left is made up
    for: all pairs of a bucket that are in different components yet and that
    the estimate does not rule out.  In a bucket of more than LARGE members
    only those outside its main component are met with all others, block by
    block: lean rows with signatures first, and then, with full sets at hand,
    those that have a candidate, for the links of a spanning forest; in
    smaller ones pairs are confirmed by a join.  Pairs within a component
    can't change it and are never made.  Nothing is capped: blocks bound what
    is held at once, not what is compared.  A large bucket of which no two
    members are linked, though all are alike, is still compared pair by pair.

    Sets are of 64-bit hashes of shingles, made by tables of random numbers.
    A link is missed if no band agrees (at 80 percent 1 in 20 million, at 85
    less than 1 in 10 billion) or the estimate is MARGIN deviations too low.

    Null and empty texts, and those of white space, have no shingles and are
    linked with nothing; very long ones are taken whole.  Rows with a null id
    have a null component and are kept.  Rows that repeat an id are one
    document: linked with each other.  Empty tables give empty results; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(_sign, SIGNED), "signatures")
    real = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("n", "f0", "f1").agg(F.min("doc_id").alias("node"))
    member = real.join(classes.select("n", again("f0").alias("f0"), "f1", "node"), ["n", "f0", "f1"])
    member = stored(member.select("doc_id", "n", "node", F.when(F.col("doc_id") == F.col("node"), F.col("bands")).alias("bands"), F.when(F.col("doc_id") == F.col("node"), F.col("bits")).alias("bits")), "classes")
    nodes = member.filter("bands IS NOT NULL").select("node", "n", "bands", "bits")

    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    ends = banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    met = stored(banded.join(ends.select(again("key").alias("key"), "least", "most"), "key"), "met")
    asked = met.select("node").distinct()
    sets = stored(rows.join(asked, F.col("doc_id") == F.col("node"), "left_semi").mapInArrow(_shingled, "node long, items array<long>"), "sets")
    lean = nodes.join(asked, "node", "left_semi").select("node", "n", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF))).cast("array<int>").alias("bands"), "bits")
    lean = stored(lean, "lean")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(y, "b").join(x, "a").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    star = met.select(F.explode(F.array("least", "most")).alias("end"), "node").filter("end <> node")
    star = star.select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b")).distinct()
    x = lean.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    y = lean.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    star = star.join(y, "b").join(x, "a").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "bits_a", "bits_b")
    star = stored(star.mapInArrow(_likely(percent), "a long, b long"), "star-pairs")
    twice = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    repeats = member.select("doc_id", "node").join(twice, "doc_id").select("a", F.col("node").alias("b"))
    links = stored(confirmed(star).unionByName(repeats).distinct(), "links")
    known = components(links)

    placed = stored(lean.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    part = met.select("key", "band", "node").join(placed.select("node", "n", "component"), "node")
    part = stored(part, "parted")
    each = part.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    open_keys = each.groupBy("key").agg(F.max(F.struct("size", "items", "component")).alias("main"), F.sum("size").alias("size"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")

    def chunks(size, items):
        return F.greatest(F.ceil(size / BLOCK), F.ceil(items / BLOCK_ITEMS)).cast("int")

    large = F.col("size") > LARGE
    open_keys = open_keys.select(
        again("key").alias("key"), large.alias("large"), F.col("main.component").alias("main"),
        F.when(large, chunks(F.col("main.size"), F.col("main.items"))).otherwise(0).alias("ours"),
        F.when(large, chunks(F.col("size") - F.col("main.size"), F.col("items") - F.col("main.items"))).otherwise(chunks(F.col("size"), F.col("items"))).alias("others"),
    )
    part = part.join(open_keys, "key")
    # Chunks 0 .. others - 1 are met with each other and with those of the main component, which come after.
    inside = F.col("large") & (F.col("component") == F.col("main"))
    some = F.xxhash64("node")
    part = part.withColumn("chunk", F.when(inside, F.col("others") + F.pmod(some, F.col("ours"))).otherwise(F.pmod(some, F.col("others"))).cast("int"))
    width = F.col("others") + F.col("ours")
    with_others = F.sequence(F.lit(0), F.col("others") - 1)
    with_all = F.sequence(F.lit(0), width - 1)
    part = part.withColumn("other", F.explode(F.when(inside, with_others).otherwise(with_all)))
    pair = F.least("chunk", "other").cast("long") * width + F.greatest("chunk", "other")
    block = pair * 2 + (F.col("chunk") != F.col("other")).cast("int")
    part = stored(part.select("key", "band", "node", "chunk", "large", block.alias("block")), "blocks")
    given = ["key", "block", "node", "component", "n", "band", "chunk", "bands", "bits"]

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(placed, "node").repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "node")

    # Lean rows first: full sets go only to members of large buckets that the estimate leaves a candidate.
    asked_for = stored(dealt(part.filter("large")).select(*given).mapInArrow(_open(percent), "key long, block long, node long"), "open")
    work = part.filter("large").join(asked_for, ["key", "block", "node"], "left_semi").join(sets, "node")
    work = dealt(work).select(*given, "items")
    near = stored(work.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")
    pairs = stored(dealt(part.filter("NOT large")).select(*given).mapInArrow(_pairs(percent), "a long, b long").distinct(), "pairs")
    near = near.unionByName(stored(confirmed(pairs).distinct(), "links"))
    if not near.isEmpty():
        known = components(links.unionByName(near))
    known = known.select(F.col("node").alias("to"), "component")
    out = member.select("doc_id", F.col("n").alias("n_shingles"), "node").join(known, F.col("node") == F.col("to"), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component at 85 percent."""
    return near_groups(table(spark, sf_dir, "documents"), percent=85)
