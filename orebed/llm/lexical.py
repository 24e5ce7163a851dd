"""Ranked lexical search over documents that recursive graph bisection has put in order."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, stored, table
from .words import Words, slices

#: Documents, and terms of each at most, from which the upper levels of the bisection are learnt, and their terms that count.
FIT_DOCS, FIT_TERMS, FIT_VOCABULARY = 2048, 1000, 65_536
#: Levels of bisection that are learnt, and rounds of swaps a level.
DEPTH, ROUNDS = 5, 6
#: Documents and postings that one task brings in order, and documents of a shard.
CHUNK_DOCS, CHUNK_POSTINGS, SHARD_DOCS = 4096, 1_000_000, 256
#: Shards that a query visits in its first rounds; after them all that can still matter.
VISITS = (4, 32)

#: Fixed by the contract of the query: all ASCII but letters and digits parts terms.
_PARTS = np.zeros(256, dtype=bool)
_PARTS[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True

BAG = "doc_id long, n long, cluster int, terms array<long>, tfs array<int>"
POSTED = "shard long, term long, docs array<int>, impacts array<int>, ids array<long>"


def bags(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text the number of its terms, their sorted distinct hashes, and how often each occurs."""
    w = Words(texts, lower=True, blank=_PARTS)
    h = w.hashes().view(np.int64)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        terms, times = np.unique(h[a:b], return_counts=True)
        yield int(b - a), terms, times.astype(np.int32)


def _cost(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits that a term's list takes in a part of n documents of which d have it, about."""
    return d * np.log2(n / (d + 1.0))


@dataclasses.dataclass
class Halves:
    """One level of a bisection: parts, and of each (part, term) the documents on either side."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray


def bisect(doc: np.ndarray, term: np.ndarray, n_docs: int, n_terms: int, levels: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[Halves]]:
    """The part of each document after ``levels`` halvings, numbered in order, and what was seen on the way.

    ``doc`` and ``term`` are postings.  In each part documents swap sides while
    that makes the lists' gaps cheaper (Dhulipala and others, 2016): pairs by
    falling gain, as long as the two gains add up to more than 0.
    """
    part, seen = np.zeros(n_docs, np.int64), []
    for level in range(levels):
        parts = 1 << level
        order = np.argsort(part, kind="stable")
        starts = np.searchsorted(part[order], np.arange(parts))
        size = np.diff(np.append(starts, n_docs))
        rank = np.empty(n_docs, np.int64)
        rank[order] = np.arange(n_docs) - starts[part[order]]
        side = rank >= (size[part] + 1) // 2
        key = part[doc] * n_terms + term
        for last in (False,) * rounds + (True,):
            right_of = side[doc]
            left = np.bincount(key[~right_of], minlength=parts * n_terms)
            right = np.bincount(key[right_of], minlength=parts * n_terms)
            sizes = np.stack([np.bincount(part[~side], minlength=parts), np.bincount(part[side], minlength=parts)])
            if last:
                break
            n1, n2 = np.maximum(sizes[0], 1)[part[doc]], np.maximum(sizes[1], 1)[part[doc]]
            a, b = left[key], right[key]
            now = _cost(a, n1) + _cost(b, n2)
            step = np.where(right_of, -1, 1)
            gain = np.bincount(doc, now - _cost(a - step, n1) - _cost(b + step, n2), minlength=n_docs)
            by = np.lexsort((-gain, side, part))
            group = part[by] * 2 + side[by]
            begins = np.searchsorted(group, np.arange(2 * parts))
            place = np.arange(n_docs) - begins[group]
            width = int(size.max()) if n_docs else 0
            best = np.full((2, parts, width), -np.inf)
            best[side[by].astype(int), part[by], place] = gain[by]
            swap = best[0] + best[1] > 1e-9
            moves = swap[part[by], place]
            if not moves.any():
                break
            side[by[moves]] ^= True
        seen.append(Halves(left.reshape(parts, n_terms), right.reshape(parts, n_terms), sizes))
        part = part * 2 + side
    return part, seen


@dataclasses.dataclass
class Router:
    """The upper levels of the bisection: each term pulls to the side where it costs fewer bits."""

    vocabulary: np.ndarray
    pulls: list[np.ndarray]
    cuts: list[np.ndarray]

    def clusters(self, terms: list[np.ndarray]) -> np.ndarray:
        n = len(terms)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        flat = np.concatenate(terms) if n else np.zeros(0, np.int64)
        part = np.zeros(n, np.int64)
        if not len(self.vocabulary):
            return part
        at = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == flat
        doc, at = doc[known], at[known]
        for pull, cut in zip(self.pulls, self.cuts, strict=True):
            part = part * 2 + (np.bincount(doc, pull[part[doc], at], minlength=n) < cut[part])
        return part


def learn(terms: list[np.ndarray], depth: int = DEPTH) -> Router:
    """A router from sampled documents' terms; the cut of a part is the median pull of its documents."""
    flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    words, times = np.unique(flat, return_counts=True)
    often = np.flatnonzero(times > 1)
    vocabulary = np.sort(words[often[np.argsort(-times[often], kind="stable")[:FIT_VOCABULARY]]])
    if not len(vocabulary):
        return Router(vocabulary, [], [])
    doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    doc, at = doc[known], at[known]
    _, seen = bisect(doc, at, len(terms), len(vocabulary), depth)
    pulls, cuts, part = [], [], np.zeros(len(terms), np.int64)
    for h in seen:
        n1, n2 = (np.maximum(s, 1)[:, None].astype(float) for s in h.sizes)
        more = lambda d, n: _cost(d + 1, n + 1) - _cost(d, n)
        unknown = more(np.zeros_like(n2), n2) - more(np.zeros_like(n1), n1)
        pulls.append((more(h.right, n2) - more(h.left, n1) - unknown).astype(np.float32))
        value = np.bincount(doc, pulls[-1][part[doc], at], minlength=len(terms))
        cuts.append(np.array([np.median(value[part == p]) if (part == p).any() else 0.0 for p in range(len(pulls[-1]))]))
        part = part * 2 + (value < cuts[-1][part])
    return Router(vocabulary, pulls, cuts)


def _bagged(router: Router | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = router.value if router is not None else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                n, terms, times = (list(x) for x in zip(*bags(texts[a:b]), strict=True))
                cluster = held.clusters(terms) if held is not None else np.zeros(len(n), np.int64)
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(cluster.astype(np.int32)), pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.record_batch(columns, names=["doc_id", "n", "cluster", "terms", "tfs"])

    return run


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _indexed(n_docs: int, n_terms: int) -> Callable:
    """The shards of each chunk: a row for each of its terms, and one with the documents' ids."""

    def shards(t: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk = int(t.column("chunk")[0].as_py())
        t = t.combine_chunks()
        sizes = t.column("terms").combine_chunks().value_lengths().to_numpy()
        terms = t.column("terms").combine_chunks().flatten().to_numpy()
        tfs = t.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(t.num_rows), sizes)
        m = 50 + (50 * t.column("n").to_numpy() * n_docs) // max(1, n_terms)
        impact = (1_000_000_000 * tfs // (1000 * tfs + 20 * m[doc])).astype(np.int32)
        words, at, times = np.unique(terms, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        use = shared[at]
        levels = max(0, int(np.ceil(np.log2(max(1, t.num_rows / SHARD_DOCS)))))
        part, _ = bisect(doc[use], number[at[use]], t.num_rows, max(1, int(shared.sum())), levels)
        # A place within the shard for each document, ascending by id within it.
        ids = t.column("doc_id").combine_chunks()
        order = np.argsort(part, kind="stable")
        place = np.empty(t.num_rows, np.int64)
        place[order] = np.arange(t.num_rows) - np.searchsorted(part[order], part[order])
        by = np.lexsort((place[doc], at, part[doc]))
        cut = np.searchsorted(part[doc][by], np.arange((1 << levels) + 1))
        firsts = np.searchsorted(part[order], np.arange((1 << levels) + 1))
        for p in range(1 << levels):
            own, rows = by[cut[p] : cut[p + 1]], order[firsts[p] : firsts[p + 1]]
            if not len(rows):
                continue
            shard = (chunk << 20) + p
            yield pa.record_batch([pa.array([shard]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids.take(pa.array(rows)))], names=["shard", "term", "docs", "impacts", "ids"])
            if not len(own):
                continue
            new = np.flatnonzero(np.diff(at[own], prepend=-1))
            offsets = np.append(new, len(own))
            columns = [pa.array(np.full(len(new), shard)), pa.array(words[at[own][new]]), _lists(offsets, place[doc[own]].astype(np.int32)), _lists(offsets, impact[own]), pa.nulls(len(new), pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["shard", "term", "docs", "impacts", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            chunk, start = batch.column("chunk").to_numpy(), 0
            while start < len(chunk):
                end = start + int((chunk[start:] == chunk[start]).argmin() or len(chunk) - start)
                if held and held[0].column("chunk")[0].as_py() != chunk[start]:
                    yield from shards(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from shards(pa.Table.from_batches(held))

    return run


@dataclasses.dataclass
class Index:
    """Posting lists by shard (``shard, term, docs, impacts, ids``), the documents with a term, and all terms' number."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """Every row of ``docs`` in shards of about SHARD_DOCS documents that have terms in common.

    Recursive graph bisection orders documents.  Its upper DEPTH levels are
    learnt from at most FIT_DOCS sampled rows and route every row to a cluster;
    clusters are dealt in chunks, each of which one task bisects further, on
    all of its own documents and terms, into shards.  What the sample is like
    bears on the shards alone, not on any result.

    Null and empty texts, and those without terms, are in the index with no
    term.  Rows that repeat an id are documents of their own.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    share = 0.9 * FIT_DOCS / max(1, rows.count())
    some = rows.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = some.mapInArrow(_bagged(None), BAG).filter((F.size("terms") > 0) & (F.size("terms") <= FIT_TERMS)).select("terms").limit(FIT_DOCS).collect()
    router = spark.sparkContext.broadcast(learn([np.array(r["terms"], np.int64) for r in sample]))
    bagged = stored(rows.mapInArrow(_bagged(router), BAG).withColumn("row", F.monotonically_increasing_id()), "bags")
    total = bagged.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # One row for each of at most 2 ** DEPTH clusters.
    counts = bagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("terms")).alias("postings"))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("postings") / CHUNK_POSTINGS), F.lit(1))
    counts = counts.select(F.col("cluster").alias("of"), chunks.alias("chunks"))
    dealt = bagged.join(F.broadcast(counts), F.col("cluster") == F.col("of"))
    chunk = F.pmod(F.xxhash64("row"), F.col("chunks")) * (1 << DEPTH) + F.col("cluster")
    dealt = dealt.select("doc_id", "n", "terms", "tfs", "row", chunk.alias("chunk")).repartition("chunk").sortWithinPartitions("chunk", "row")
    postings = dealt.select("chunk", "doc_id", "n", "terms", "tfs").mapInArrow(_indexed(total["docs"], total["terms"]), POSTED)
    return Index(stored(postings, "postings"), total["docs"], total["terms"])


def _visit(k: int) -> Callable:
    """The k best documents of a shard for each query that visits it, none below the query's score to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, missing, lists = None, None, None, {}
        for batch in batches:
            rows = {c: batch.column(c) for c in batch.schema.names}
            docs, impacts = rows["docs"], rows["impacts"]
            out: list[tuple] = []
            for i, (s, kind) in enumerate(zip(rows["shard"].to_pylist(), rows["kind"].to_pylist(), strict=True)):
                if s != shard:
                    shard, lists = s, {}
                if kind == 0:
                    own = rows["ids"][i].values
                    missing = own.is_null().to_numpy(zero_copy_only=False)
                    ids = own.fill_null(np.iinfo(np.int64).max).to_numpy()
                elif kind == 1:
                    lists[rows["term"][i].as_py()] = (docs[i].values.to_numpy(), impacts[i].values.to_numpy().astype(np.int64))
                else:
                    score = np.zeros(len(ids), np.int64)
                    for term, weight in zip(rows["terms"][i].as_py(), rows["weights"][i].as_py(), strict=True):
                        if term in lists:
                            at, impact = lists[term]
                            score[at] += weight * impact
                    good = np.flatnonzero(score >= rows["least"][i].as_py())
                    good = good[np.lexsort((ids[good], -score[good]))][:k]
                    item = rows["item_id"][i].as_py()
                    out += [(item, None if missing[g] else int(ids[g]), int(score[g])) for g in good.tolist()]
            if out:
                yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = 50, id_column: str = "item_id", text_column: str = "text", visits: tuple[int, ...] = VISITS) -> DataFrame:
    """Rows ``item_id, rank, doc_id, score``: each query's k highest-scoring documents above 0.

    A score sums weight * impact over the query's distinct terms, where
    weight = floor(1000 ln((2 N + 2) / (2 df + 1))) and impact =
    10^9 tf div (1000 tf + 20 m), m = 50 + (50 n N) div L.  Equal scores rank by
    ascending id, a null id last.

    The sum over a query's terms of weight * greatest impact in a shard bounds
    the scores there.  A query visits shards by falling bound, in rounds: the
    first few, then more, then all the rest, and in each only those whose bound
    reaches the score of its k-th document so far; shards below it can't hold a
    document that ranks, nor one that ties.  So the result is exact.

    Queries without terms, or with a null id, have no rows; rows that repeat an
    id are one query of all their terms.
    """
    texts = pick(queries, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    asked = texts.mapInArrow(_bagged(None), BAG).select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()
    asked = stored(asked, "asked")
    words = asked.select("term").distinct()
    lists = stored(index.postings.filter("term IS NOT NULL").join(words, "term", "left_semi").select("shard", "term", "docs", "impacts", F.array_max("impacts").cast("long").alias("most")), "lists")
    ids = index.postings.filter("term IS NULL").select("shard", F.lit(0).alias("kind"), "ids")
    df = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = stored(asked.join(df.select("term", weight.alias("weight")), "term").filter("weight > 0"), "weights")
    items = weighed.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    bounds = lists.select("shard", "term", "most").join(weighed, "term").groupBy("item_id", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))
    order = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard"))
    bounds = stored(bounds.withColumn("no", order), "bounds")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top, done = None, 0
    for upto in (*visits, None):
        open_ = bounds.filter(F.col("no") > done) if upto is None else bounds.filter((F.col("no") > done) & (F.col("no") <= upto))
        if top is None:
            open_ = open_.withColumn("least", F.lit(1).cast("long"))
        else:
            beat = top.filter(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
            open_ = open_.join(beat, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(1).cast("long"))).filter("bound >= least")
        open_ = stored(open_.select("item_id", "shard", "least"), "visits")
        done = upto or done
        near = open_.select("shard").distinct()
        work = lists.join(near, "shard", "left_semi").select("shard", F.lit(1).alias("kind"), "term", "docs", "impacts")
        work = work.unionByName(ids.join(near, "shard", "left_semi"), allowMissingColumns=True)
        work = work.unionByName(open_.join(items, "item_id").withColumn("kind", F.lit(2)), allowMissingColumns=True)
        found = work.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(_visit(k), "item_id long, doc_id long, score long")
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = stored(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "top")
    return top.select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
