"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored, table
from .words import Words, mix, slices

#: An overlap counts from so many words on (or the whole item, if that is shorter) ...
MIN_WORDS = 13
#: ... if this share of its words is the same.
SIMILARITY = 0.8
#: Masks by the words of an item, the last for longer items too: positions with 1 are hashed, those with 0
#: may hold any word.  At MIN_WORDS and SIMILARITY each set hits every overlap that counts.
MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("111111", "1111101", "1111011", "1110111", "1101111", "1011111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("1111011", "11001111", "110110011", "11110101", "10101111"),
    11: ("1110111", "111001011", "1011111", "111111"),
    12: ("11101011", "101100111", "111111"),
    13: ("1101111", "1111101", "1100010111", "11011000011"),
}
#: Words of benchmark items that one broadcast index holds at most; a larger benchmark
#: takes further passes over the documents.
INDEX_WORDS = 2_000_000
#: Words that are compared in one go.
BLOCK_PLACES = 1 << 20
_BITS = 22


def masks_for(length: int, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> tuple[str, ...]:
    """Masks of which at least one fits into every overlap of an item of so many words."""
    if (min_words, similarity) == (MIN_WORDS, SIMILARITY) and length >= min(MASKS):
        return MASKS[min(length, max(MASKS))]
    # Of twice the words or more, one half is an overlap too.  So many words stand between two changed ones at least.
    sizes = range(max(1, min(min_words, length)), min(length, 2 * min_words - 1) + 1)
    changed = {n: int(n * (1 - similarity) + 1e-9) for n in sizes}
    return ("1" * max(1, min(-((k - n) // (k + 1)) for n, k in changed.items())),)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's words at every place where all of it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask), np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            total += words[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    return mix(total)


def longest_overlap(same: np.ndarray, similarity: float) -> int:
    """Length of the longest stretch in which at least that share is true."""
    score = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))]) + 0.0
    score = np.round(score, 9)
    lowest = np.minimum.accumulate(score)
    # The first place whose score is no higher than at the end of the stretch.
    begin = np.searchsorted(-lowest, -score, side="left")
    return int((np.arange(len(score)) - begin).max())


@dataclasses.dataclass
class Index:
    """Seeds of a block of benchmark items, by mask."""

    items: list[int]
    words: list[np.ndarray]
    seeds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple[int, str]], min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> Index:
        w = Words([t for _, t in items], lower=True, signs=True)
        h = w.hashes()
        words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        found: dict[str, list[tuple[np.ndarray, int]]] = {}
        for k, x in enumerate(words):
            for mask in masks_for(len(x), min_words, similarity) if len(x) else ():
                found.setdefault(mask, []).append((seed_hashes(x, mask), k))
        seeds = {}
        for mask, parts in found.items():
            s = np.concatenate([p for p, _ in parts])
            item = np.concatenate([np.full(len(p), k) for p, k in parts])
            at = np.concatenate([np.arange(len(p)) for p, _ in parts])
            order = np.argsort(s, kind="stable")
            seeds[mask] = (s[order], item[order], at[order])
        return Index([i for i, _ in items], words, seeds)

    def overlaps(self, texts: list[str], min_words: int, similarity: float) -> list[dict[int, int]]:
        """For each text, the items that it overlaps and the words of the longest overlap."""
        w = Words(texts, lower=True, signs=True)
        h = w.hashes()
        out: list[dict[int, int]] = [{} for _ in texts]
        # A hit is an item and the place in the text where its first word would be, as one number.
        longest = max(map(len, self.words), default=0)
        span = len(h) + longest + 1
        found = [np.zeros(0, np.int64)]
        for mask, (seeds, item, at) in self.seeds.items():
            s = seed_hashes(h, mask)
            sieve = np.zeros(1 << _BITS, bool)
            sieve[seeds >> np.uint64(64 - _BITS)] = True
            hits = np.flatnonzero(sieve[s >> np.uint64(64 - _BITS)])
            lo, hi = np.searchsorted(seeds, s[hits], "left"), np.searchsorted(seeds, s[hits], "right")
            upto = np.cumsum(hi - lo)
            # Repetitive texts hit the same item over and over: so many at a time, each kept once.
            cuts = np.searchsorted(upto, np.arange(BLOCK_PLACES, (upto[-1] if len(upto) else 0) + BLOCK_PLACES, BLOCK_PLACES), "left") + 1
            for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if len(cuts) else ():
                n = hi[i:j] - lo[i:j]
                k = np.repeat(lo[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append(np.unique(item[k] * span + np.repeat(hits[i:j], n) - at[k] + longest))
        keys = np.unique(np.concatenate(found))
        pairs = np.stack([keys // span, keys % span - longest], axis=1)
        for k, places in self._close(h, pairs, min_words, similarity):
            own = self.words[k]
            # The seed lies within the item; texts that the item reaches over at its place are cut apart.
            text = np.searchsorted(w.first, np.maximum(places, 0), "right") - 1
            while len(places):
                at = places[:, None] + np.arange(len(own))
                inside = (at >= w.first[text][:, None]) & (at < w.first[text + 1][:, None])
                same = (h[np.clip(at, 0, len(h) - 1)] == own) & inside
                # Places that agree in the same words have the same overlap: repetitive texts have few kinds.
                key = np.packbits(np.concatenate([same, inside], axis=1), axis=1)
                _, one, kind = np.unique(key, axis=0, return_index=True, return_inverse=True)
                most = np.array([longest_overlap(same[i][inside[i]], similarity) for i in one.tolist()])[kind.ravel()]
                for i in np.flatnonzero(most >= min(min_words, len(own))).tolist():
                    mine = out[int(text[i])]
                    mine[self.items[k]] = max(int(most[i]), mine.get(self.items[k], 0))
                further = (w.first[text + 1] < places + len(own)) & (text + 1 < len(texts))
                places, text = places[further], text[further] + 1
        return out

    def _close(self, h: np.ndarray, pairs: np.ndarray, min_words: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
        """By item, and BLOCK_PLACES at a time, the places with as many words the same as the shortest overlap has."""
        bounds = [*np.flatnonzero(np.diff(pairs[:, 0], prepend=-1)), len(pairs)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = self.words[pairs[a, 0]]
            same = np.zeros(b - a, np.int64)
            for j, word in enumerate(own):
                at = pairs[a:b, 1] + j
                same += (h[np.clip(at, 0, len(h) - 1)] == word) & (at >= 0) & (at < len(h))
            places = pairs[a:b, 1][same >= similarity * min(min_words, len(own)) - 1e-9]
            step = max(1, BLOCK_PLACES // len(own))
            for i in range(0, len(places), step):
                yield int(pairs[a, 0]), places[i : i + step]


def _hits(index, min_words: int, similarity: float) -> Callable:
    """``row, items, overlap`` of the texts that overlap an item of the index."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = batch.column("row").to_pylist()
            found = [x for a, b in slices(texts) for x in index.value.overlaps(texts[a:b], min_words, similarity)]
            own = [(r, sorted(x), max(x.values())) for r, x in zip(rows, found, strict=True) if x]
            if own:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*own, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["row", "items", "overlap"])

    return find


def _finder(index, min_words: int, similarity: float) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [x for a, b in slices(texts) for x in index.value.overlaps(texts[a:b], min_words, similarity)]
            before = batch.column("items").to_pylist(), batch.column("overlap").to_pylist()
            items = [sorted({*old, *new}) for old, new in zip(before[0], found, strict=True)]
            most = [max(old, *new.values()) if new else old for old, new in zip(before[1], found, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(most, pa.int64())], names=["doc_id", "text", "items", "overlap"])

    return find


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, index_words: int = INDEX_WORDS, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """Rows ``doc_id, text, items, overlap``, one for each input row.

    ``items`` has the sorted ids of benchmark items that the text overlaps and
    ``overlap`` the words of the longest overlap.  Words are runs of ASCII
    letters, digits and non-ASCII characters, A-Z lower-cased.

    Masks, chosen by the item's length so that every overlap is hit, are laid
    at every place of an item and of a text; places with equal hashes of the
    unmasked words are hits.  Around each hit the whole
    item is compared with the text word by word: an overlap is a stretch of
    ``min_words`` words or more, ``similarity`` of them the same.

    The index is broadcast; it holds ``index_words`` words of items at most,
    and a larger benchmark is taken in blocks.  Each block is a pass of its own
    over the written texts, which writes what it finds and lets go of its index:
    a task runs one Python stage and holds one index, whatever their number.

    Null and empty texts overlap nothing; very long ones are searched whole.
    Rows that repeat an id or a text are searched each.  Null item texts and
    null items are left out; items that repeat an id are looked for each.  An
    empty benchmark finds nothing, an empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item=item_column, text="text").filter("item IS NOT NULL AND text IS NOT NULL").select(F.col("item").cast("long").alias("item"), "text")
    words = items.agg(F.sum(F.size(F.split("text", r"[\s\p{Punct}]+")).cast("long"))).first()[0] or 0
    blocks = -(-words // index_words)
    out = pick(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr("CAST(array() AS array<bigint>)").alias("items"), F.lit(0).cast("long").alias("overlap"))

    def built(k: int):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast(Index.build([(r["item"], r["text"]) for r in sorted(block)], min_words, similarity))

    if blocks == 1:
        return out.mapInArrow(_finder(built(0), min_words, similarity), "doc_id long, text string, items array<long>, overlap long")
    if not blocks:
        return out
    held = stored(out.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "texts")
    found = []
    for k in range(blocks):
        index = built(k)
        found.append(stored(held.mapInArrow(_hits(index, min_words, similarity), "row long, items array<long>, overlap long"), "overlaps"))
        index.destroy()
    every = functools.reduce(DataFrame.unionAll, found).groupBy(F.col("row").alias("of")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("overlap").alias("overlap"))
    out = held.join(every, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "text", F.coalesce("items", F.expr("CAST(array() AS array<bigint>)")).alias("items"), F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    out = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", F.col("overlap").alias("overlap_words"))
