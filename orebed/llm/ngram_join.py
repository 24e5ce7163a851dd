"""Similarity join of texts on word n-grams: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near
from .common import again, pick, stored, table
from .components import components
from .words import Words, mix, runs, slices

SHINGLE = 4
#: One in so many n-grams, by its hash, comes first in the order; of the others only texts that lack those take any.
FIRST = 5
#: Classes of hashes in which the suffix filter counts a set's n-grams.
PIVOTS = 64

SIGNED = "doc_id long, n int, f0 long, f1 long, first int, counts binary, asked array<long>"


def ngram_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's n-grams; a text of fewer words is one."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = runs(h, size)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield mix(runs(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """So many n-grams of a set can't all be missing in another that is similar enough."""
    return n - -(-percent * n // 100) + 1


def _measure(size: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                out: dict[str, list] = {c: [] for c in ("n", "f0", "f1", "first", "counts", "asked")}
                for s in ngram_sets(texts[a:b], size):
                    early = s[s.view(np.int64) % FIRST == 0]
                    out["n"].append(len(s))
                    out["f0"].append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    out["f1"].append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                    out["first"].append(len(early))
                    out["counts"].append(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PIVOTS).astype(np.int32).tobytes())
                    out["asked"].append((early if len(early) >= prefix_length(len(s), percent) else s).view(np.int64))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                columns = [batch.column("doc_id").slice(a, b - a), *[pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]]
                yield pa.record_batch(columns, names=["doc_id", *out])

    return run


def needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection at which sets of these sizes are linked."""
    return F.ceil(percent * (n + m) / (100 + percent)).cast("int")


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n.astype(np.int64) + m) // (100 + percent))


def _histograms(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, PIVOTS)


def _suffix(percent: int) -> Callable:
    """The pairs ``a, b, na, nb, ca, cb`` whose sets may have enough in common, class by class of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                most = np.minimum(_histograms(batch.column("ca")), _histograms(batch.column("cb"))).sum(1)
                ok = pa.array(most >= _needed(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), percent))
                yield pa.record_batch([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])

    return run


def _candidates(held: pa.Table, percent: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Pairs of rows of one block, not in one component yet, that pass all filters; a pair is met under its first common key alone."""
    cols = {c: held.column(c).to_numpy() for c in ("key", "block", "node", "component", "n", "pos", "chunk")}
    counts, prefixes = _histograms(held.column("counts")), held.column("prefix").combine_chunks()
    values, starts = prefixes.flatten().to_numpy(), np.concatenate([[0], np.cumsum(prefixes.value_lengths().to_numpy())])
    new = np.flatnonzero((np.diff(cols["key"], prepend=cols["key"][0] - 1) != 0) | (np.diff(cols["block"], prepend=-1) != 0))
    end = np.repeat(np.append(new[1:], held.num_rows), np.diff(np.append(new, held.num_rows)))
    whole, n, pos = cols["block"] % 2 == 0, cols["n"].astype(np.int64), cols["pos"].astype(np.int64)
    at, d = np.arange(held.num_rows), 0
    found_a, found_b = [], []
    while True:
        d += 1
        at = at[at + d < end[at]]
        # Rows of a block ascend by size: who is too long for a row stays so.
        at = at[100 * n[at] >= percent * n[at + d]] if len(at) else at
        if not len(at):
            break
        other = at + d
        ok = (cols["component"][at] != cols["component"][other]) & (whole[at] | (cols["chunk"][at] != cols["chunk"][other]))
        a, b = at[ok], other[ok]
        least = _needed(n[a], n[b], percent)
        ok = np.minimum(pos[a], pos[b]) + 1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= least
        a, b, least = a[ok], b[ok], least[ok]
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            ok = np.minimum(counts[x], counts[y]).sum(1) >= least[k : k + 65536]
            found_a.append(x[ok])
            found_b.append(y[ok])
    a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
    # Prefixes ascend: the first key of one that the other has.
    first, key = np.zeros(len(a), bool), cols["key"]
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = values[starts[i] : starts[i + 1]], values[starts[j] : starts[j + 1]]
        x, y = x[: np.searchsorted(x, key[i])], y[: np.searchsorted(y, key[i])]
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        first[k] = not (len(x) and len(y) and (x[at] == y).any())
    return cols, a[first], b[first]


_FOUND = "key long, block long, a long, b long"


def _possible(percent: int) -> Callable:
    """Of large buckets the members that have a partner, with a null ``b``; of others the pairs."""

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols, a, b = _candidates(held, percent)
        large = held.column("large").to_numpy(zero_copy_only=False)
        some = np.unique(np.concatenate([a[large[a]], b[large[b]]])).astype(np.int64)
        a, b = a[~large[a]], b[~large[a]]
        node = cols["node"]
        columns = [np.concatenate([cols["key"][some], cols["key"][a]]), np.concatenate([cols["block"][some], cols["block"][a]]), np.concatenate([node[some], node[a]])]
        others = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b], pa.int64())])
        return pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], others], names=["key", "block", "a", "b"])

    return near._by_block(compare)


def _confirmed(percent: int) -> Callable:
    """Links within blocks of rows that carry their sets: a spanning forest of what is linked in each."""

    def compare(held: pa.Table) -> pa.RecordBatch:
        cols, a, b = _candidates(held, percent)
        items = held.column("items").combine_chunks()
        sizes = items.value_lengths().to_numpy()
        values, starts = items.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(sizes)])
        tree, of, links = near._Forest(), cols["component"], []
        for k in range(0, len(a), 512):
            u, v = a[k : k + 512], b[k : k + 512]
            apart = np.fromiter((tree.find(p) != tree.find(q) for p, q in zip(of[u].tolist(), of[v].tolist(), strict=True)), bool, len(u))
            u, v = u[apart], v[apart]
            both = near._common(values, starts, u, v)
            sure = 100 * both >= percent * (sizes[u] + sizes[v] - both)
            links += [(i, j) for i, j in zip(u[sure].tolist(), v[sure].tolist(), strict=True) if tree.join(int(of[i]), int(of[j]))]
        u, v = (cols["node"][np.array([x[k] for x in links], np.int64)] for k in (0, 1))
        return near._edges(u, v)

    return near._by_block(compare)


def _items(size: int) -> Callable:
    """``node, items`` of the rows whose set has the fingerprint that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes, marks = (batch.column(c).to_pylist() for c in ("text", "node", "f0"))
            for a, b in slices(texts):
                sets = list(ngram_sets(texts[a:b], size))
                own = [i for i, s in enumerate(sets) if int(mix(s).sum(dtype=np.uint64).view(np.int64)) == marks[a + i]]
                yield pa.record_batch([pa.array([nodes[a + i] for i in own], pa.int64()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], names=["node", "items"])

    return run


def _prefixes(signed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """A stored table ``key, node, n, pos``: the n-grams of each set's prefix that other prefixes may share."""
    asked = signed.filter("n > 0 AND doc_id IS NOT NULL").join(nodes.select("node"), F.col("row") == F.col("node"), "left_semi")
    asked = asked.select(F.col("row").alias("node"), "n", "first", F.size("asked").alias("asked"), F.explode("asked").alias("key"))
    often = asked.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    known = stored(asked.join(often.select(again("key").alias("key"), "sets"), "key"), "repeated-ngrams")
    late = F.pmod("key", F.lit(FIRST)) != 0
    listed = known.groupBy("node", "n", "first", "asked").agg(F.array_sort(F.collect_list(F.struct(late.alias("late"), "sets", "key"))).alias("order"))
    early = F.size(F.filter("order", lambda x: ~x["late"]))
    each = listed.withColumn("early", early).select("*", F.posexplode("order").alias("i", "gram"))
    # N-grams that no other set has come before those that are repeated.
    pos = F.when(F.col("gram.late"), F.col("asked") - F.size("order") + F.col("i")).otherwise(F.col("first") - F.col("early") + F.col("i"))
    limit = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    return stored(each.select(F.col("gram.key").alias("key"), "node", "n", pos.cast("int").alias("pos")).filter(F.col("pos") < limit), "prefixes")


def similar_groups(docs: DataFrame, percent: int = 80, size: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id``, one for each input row.

    Two texts are linked if their sets of distinct n-grams of ``size`` words
    (A-Z lower-cased; a text of fewer words is one n-gram) have 100 *
    intersection >= percent * union; ``component_id`` is the smallest id
    reachable over links.

    Rows with the same set form a class.  N-grams are ordered by the number of
    classes that have them, rarest first, and a class joins others on those of
    its prefix alone.  One n-gram in FIRST, chosen by hash, precedes all others
    in the order, so that mostly these are counted; a set that has too few of
    them for its prefix asks for all its own.  N-grams that one class alone
    has fill a prefix without being joined.

    Pairs that meet under an n-gram are filtered by length and by place
    (positional filter), then by counts of both sets in PIVOTS ranges of hashes
    (suffix filter, its pivots fixed), and what is left is verified on whole
    sets, once a pair.  First all members of an n-gram meet two of it, those
    with the smallest and the largest number; then only members of different
    components meet, in blocks: lean rows first, and whole sets only where some
    pair of a large block passes every filter.  No partners are capped.

    Sets are of 64-bit hashes of n-grams.  Null and empty texts, and those of
    white space, have no n-grams and are linked with nothing; very long ones
    are taken whole.  Rows with a null id have a null component.  Rows that
    repeat an id are one document, linked with each other.  Empty tables give
    empty results; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(rows.mapInArrow(_measure(size, percent), SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")
    real = signed.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "f0", "f1", "row")
    classes = real.groupBy("n", "f0", "f1").agg(F.min(F.struct("row", "doc_id")).alias("least"))
    classes = stored(classes.select("n", "f0", "f1", F.col("least.row").alias("node"), F.col("least.doc_id").alias("from_doc")), "classes")
    member = stored(real.join(classes.select("n", again("f0").alias("f0"), "f1", "node"), ["n", "f0", "f1"]).select("doc_id", "n", "node"), "members")

    met = _prefixes(signed, classes, percent)
    ends = met.groupBy("key").agg(F.min(F.struct("node", "n", "pos")).alias("least"), F.max(F.struct("node", "n", "pos")).alias("most")).filter("least.node < most.node")
    met = stored(met.join(ends.select(again("key").alias("key"), "least", "most"), "key"), "met")
    prefix = met.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("prefix"))
    lean = signed.select(F.col("row").alias("node"), F.col("n"), "counts").join(prefix, "node")
    lean = stored(lean, "lean")
    # The n-grams of each class that meets another, from the text of one of its rows.
    wanted = classes.join(lean.select("node"), "node", "left_semi").select(F.col("from_doc").alias("doc_id"), "f0", "node")
    sets = rows.join(wanted, "doc_id").mapInArrow(_items(size), "node long, items array<long>")
    twice = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not twice.isEmpty():
        sets = sets.dropDuplicates(["node"])
    sets = stored(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(y, "b").join(x, "a").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    star = met.select("node", "n", "pos", F.explode(F.array("least", "most")).alias("end")).filter("end.node <> node")
    star = star.select("node", "n", "pos", F.col("end.node").alias("end"), F.col("end.n").alias("m"), F.col("end.pos").alias("at"))
    fit = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    place = F.least("pos", "at") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= needed(F.col("n"), F.col("m"), percent)
    star = star.filter(fit & place).select(F.least("end", "node").alias("a"), F.greatest("end", "node").alias("b")).distinct()
    x = lean.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    y = lean.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    star = stored(star.join(y, "b").join(x, "a").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(_suffix(percent), "a long, b long"), "star-pairs")
    repeats = member.select("doc_id", "node").join(twice.filter("a <> z").select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    links = stored(confirmed(star).unionByName(repeats).distinct(), "links")
    known = components(links)

    placed = stored(lean.select("node", "counts", "prefix").join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    part = stored(met.select("key", "node", "n", "pos").join(placed.select("node", "component"), "node"), "parted")
    each = part.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    open_keys = each.groupBy("key").agg(F.max(F.struct("size", "items", "component")).alias("main"), F.sum("size").alias("size"), F.sum("items").alias("items"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")

    def chunks(size, items):
        return F.greatest(F.ceil(size / near.BLOCK), F.ceil(items / near.BLOCK_ITEMS)).cast("int")

    large = F.col("size") > near.LARGE
    open_keys = open_keys.select(
        again("key").alias("key"), large.alias("large"), F.col("main.component").alias("main"),
        F.when(large, chunks(F.col("main.size"), F.col("main.items"))).otherwise(0).alias("ours"),
        F.when(large, chunks(F.col("size") - F.col("main.size"), F.col("items") - F.col("main.items"))).otherwise(chunks(F.col("size"), F.col("items"))).alias("others"),
    )
    part = part.join(open_keys, "key")
    # Chunks 0 .. others - 1 are met with each other and with those of the main component, which come after.
    inside, some = F.col("large") & (F.col("component") == F.col("main")), F.xxhash64("node")
    part = part.withColumn("chunk", F.when(inside, F.col("others") + F.pmod(some, F.col("ours"))).otherwise(F.pmod(some, F.col("others"))).cast("int"))
    width = F.col("others") + F.col("ours")
    part = part.withColumn("other", F.explode(F.when(inside, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), width - 1))))
    block = (F.least("chunk", "other").cast("long") * width + F.greatest("chunk", "other")) * 2 + (F.col("chunk") != F.col("other")).cast("int")
    part = stored(part.select("key", "node", "n", "pos", "component", "chunk", "large", block.alias("block")), "blocks")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(placed.select("node", "counts", "prefix"), "node").repartition(F.col("key"), F.col("block")).sortWithinPartitions("key", "block", "n", "node")

    found = stored(dealt(part).mapInArrow(_possible(percent), _FOUND), "found")
    pairs = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    open_rows = part.join(found.filter("b IS NULL").select("key", "block", F.col("a").alias("node")), ["key", "block", "node"], "left_semi")
    more = dealt(open_rows.join(sets, "node")).mapInArrow(_confirmed(percent), "a long, b long")
    more = stored(confirmed(pairs).unionByName(more).distinct(), "links")
    if not more.isEmpty():
        known = components(links.unionByName(more))
    known = known.select(F.col("node").alias("to"), "component")
    out = member.join(known, F.col("node") == F.col("to"), "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"))
    least = out.groupBy("component").agg(F.min("doc_id").alias("component_id")).select(again("component").alias("component"), "component_id")
    out = out.join(least, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component at 85 percent of 4-word n-grams."""
    return similar_groups(table(spark, sf_dir, "documents"), percent=85)
