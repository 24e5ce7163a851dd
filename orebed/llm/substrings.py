"""Removal of repeated passages, with a count-min sketch before the exact pass."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, committed, file_system, pick, scratch, stored, table
from .words import Words, mix, runs, slices

#: Characters after which a writer begins the next chunk of texts.
CHUNK_CHARS = 16_000_000
#: Bytes of text to each counter in a row of the sketch; about one anchor in 80 bytes.
COUNTER_BYTES = 10
#: Rows of the sketch, and the least number of counters in one as a power of two.
DEPTH, MIN_BITS = 2, 20
#: Counters in one shard of the sketch as a power of two: least, most, and shards of a row before they grow.
SHARD_BITS, MAX_SHARD_BITS, SHARDS = 18, 27, 8
_ROW_KEYS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xF1357AEA2E62A9C5))
#: What a message to a chunk says in place of a row: that the chunk is there, or which of its counters repeat.
_HERE, _HITS = -1, -2

INDEX_SCHEMA = "chunk long, row int, doc_id long, bytes long, words long, f0 long, f1 long"
TOLD_SCHEMA = "chunk long, row int, at int, hits binary"


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window the least hash of the half-length runs in it.

    Equal windows have equal anchors, and neighbours mostly share theirs, so
    that about one anchor in seven words stands for all windows."""
    half = window // 2
    g = runs(words, half)
    span = window - half + 1
    out, have = g, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _counters(a: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(a ^ _ROW_KEYS[row]) >> np.uint64(64 - bits)


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by a column, one value's at a time."""
    held, now = [], None
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and values[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _chunk_path(folder: str, chunk: int) -> str:
    return f"{folder}/{chunk:013x}.arrow"


def _stower(folder: str) -> Callable:
    """Writes texts in chunk files, and gives each one's place, sizes and a 128-bit digest of its words."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text").to_pylist()):
                yield batch.slice(a, b - a)

    def stow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, todo = TaskContext.get().partitionId() << 20, pieces(batches)
        batch = next(todo, None)
        while batch is not None:
            row, size, index = 0, 0, []
            with committed(_chunk_path(folder, chunk)) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                while batch is not None and size < CHUNK_CHARS:
                    to.write_batch(batch)
                    w, n = Words(batch.column("text").to_pylist()), batch.num_rows
                    f = np.frombuffer(b"".join(hashlib.blake2b(w.line(i), digest_size=16).digest() for i in range(n)), "<i8").reshape(n, 2)
                    size += len(w.data)
                    index.append([pa.array(np.full(n, chunk)), pa.array(np.arange(row, row + n, dtype=np.int32)), batch.column("doc_id"), pa.array(np.full(n, len(w.data) // n)), pa.array(w.counts), pa.array(f[:, 0]), pa.array(f[:, 1])])
                    row += n
                    batch = next(todo, None)
            for columns in index:
                yield pa.record_batch(columns, names=["chunk", "row", "doc_id", "bytes", "words", "f0", "f1"])
            chunk += 1

    return stow


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places that the messages to a chunk name."""
    return table.column("row").to_numpy(), table.column("at").to_numpy()


def _long_texts(folder: str, chunk: int, gone: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray, Words, int]]:
    """Of a chunk's texts with a window or more, an id and no earlier copy: row, id, word hashes,
    words of the batch, and number in it."""
    skip = set(gone[gone >= 0].tolist())
    files, path = file_system(_chunk_path(folder, chunk))
    with files.open_input_stream(path, compression=None) as f:
        row = 0
        for batch in pa.ipc.open_stream(f):
            ids, w = batch.column("doc_id"), Words(batch.column("text").to_pylist())
            h = w.hashes()
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                if b - a >= window and ids[i].is_valid and row + i not in skip:
                    yield row + i, ids[i].as_py(), h[a:b], w, i
            row += batch.num_rows


def _sketcher(folder: str, window: int, bits: int, shard_bits: int) -> Callable:
    """Each chunk's sketch, sparse, cut into shards: counters met once or more, and those met more than once."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, told in _grouped(batches, "chunk"):
            found = [np.unique(anchors(h, window)) for _, _, h, _, _ in _long_texts(folder, chunk, _told(told)[0], window)]
            if not found:
                continue
            found = np.concatenate(found)
            for row in range(DEPTH):
                c, n = np.unique(_counters(found, row, bits), return_counts=True)
                shards = 1 << (bits - shard_bits)
                cuts = np.searchsorted(c, np.arange(shards + 1, dtype=np.uint64) << np.uint64(shard_bits))
                at = np.flatnonzero(np.diff(cuts)).tolist()
                low = (c & np.uint64((1 << shard_bits) - 1)).astype("<u4")
                once = [low[cuts[k] : cuts[k + 1]].tobytes() for k in at]
                more = [low[cuts[k] : cuts[k + 1]][n[cuts[k] : cuts[k + 1]] > 1].tobytes() for k in at]
                yield pa.record_batch([pa.array([row * shards + k for k in at], pa.int32()), pa.array([chunk] * len(at), pa.int64()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["shard", "chunk", "once", "more"])

    return sketch


def _merger(shard_bits: int) -> Callable:
    """Merges the sketches of a shard, and tells each chunk which of its counters are above 1 in all."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, twice = np.zeros(1 << shard_bits, bool), np.zeros(1 << shard_bits, bool)
        for shard, rows in _grouped(batches, "shard"):
            seen[:] = twice[:] = False
            once = [np.frombuffer(x, "<u4") for x in rows.column("once").to_pylist()]
            for c, more in zip(once, rows.column("more").to_pylist(), strict=True):
                twice[c[seen[c]]] = True
                seen[c] = True
                twice[np.frombuffer(more, "<u4")] = True
            n = len(once)
            hits = [c[twice[c]].tobytes() for c in once]
            yield pa.record_batch([rows.column("chunk").combine_chunks(), pa.array(np.full(n, _HITS, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(hits, pa.binary())], names=["chunk", "row", "at", "hits"])

    return merge


def _repeated(a: np.ndarray, hits: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether each anchor is estimated to have been counted more than once; never too low."""
    new = np.flatnonzero(np.diff(a, prepend=~a[:1]))  # runs of one anchor
    ok = np.ones(len(new), bool)
    for row in range(DEPTH):
        c = _counters(a[new], row, bits)
        k = np.searchsorted(hits[row], c)
        ok &= np.append(hits[row], ~np.uint64(0))[k] == c
    return np.repeat(ok, np.diff(np.append(new, len(a))))


def _emitter(folder: str, window: int, bits: int, shard_bits: int) -> Callable:
    """Windows that the merged sketch takes for repeated: two hashes, document and place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, told in _grouped(batches, "chunk"):
            rows, at = _told(told)
            shards, hits = 1 << (bits - shard_bits), [[np.zeros(0, np.uint64)] for _ in range(DEPTH)]
            answers = told.column("hits").to_pylist()
            for k in np.flatnonzero(rows == _HITS).tolist():
                shard = int(at[k])
                hits[shard // shards].append(np.frombuffer(answers[k], "<u4").astype(np.uint64) + (np.uint64(shard % shards) << np.uint64(shard_bits)))
            sets = [np.sort(np.concatenate(x)) for x in hits]
            out, size, words, other = [], 0, None, None
            for row, doc_id, h, w, i in _long_texts(folder, chunk, rows, window):
                where = np.flatnonzero(_repeated(anchors(h, window), sets, bits))
                if not len(where):
                    continue
                if words is not w:
                    words, other = w, w.hashes(1)
                k0, k1 = runs(h, window, 0)[where], runs(other[w.first[i] : w.first[i + 1]], window, 1)[where] >> np.uint64(32)
                n = len(where)
                out.append([k0.view(np.int64), k1.astype(np.uint32).view(np.int32), np.full(n, doc_id, np.int64), np.full(n, chunk, np.int64), np.full(n, row, np.int32), where.astype(np.int32)])
                size += n
                if size > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["k0", "k1", "doc_id", "chunk", "row", "at"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["k0", "k1", "doc_id", "chunk", "row", "at"])

    return emit


def _cutter(folder: str, window: int) -> Callable:
    """What is left of each text once the marked windows' words are gone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, told in _grouped(batches, "chunk"):
            rows, places = _told(told)
            files, path = file_system(_chunk_path(folder, chunk))
            with files.open_input_stream(path, compression=None) as f:
                row = 0
                for batch in pa.ipc.open_stream(f):
                    w = Words(batch.column("text").to_pylist())
                    total, gone, kept = w.counts, [], []
                    bounds = np.searchsorted(rows, np.arange(row, row + batch.num_rows + 1))
                    row += batch.num_rows
                    for i in range(batch.num_rows):
                        at, n = places[bounds[i] : bounds[i + 1]], int(total[i])
                        if not len(at):
                            gone.append(0)
                            kept.append(w.line(i))
                        elif at.min() < 0:  # a copy
                            gone.append(n)
                            kept.append(b"")
                        else:
                            edges = np.zeros(n + 1, np.int64)
                            np.add.at(edges, at, 1)
                            np.add.at(edges, at + window, -1)
                            keep = np.cumsum(edges[:-1]) == 0
                            gone.append(int(n - keep.sum()))
                            words = w.line(i).split(b" ")
                            kept.append(b" ".join([words[j] for j in np.flatnonzero(keep).tolist()]))
                    yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return cut


def remove_repeats(docs: DataFrame, window: int = 50, id_column: str = "doc_id", text_column: str = "text", bits: int | None = None) -> DataFrame:
    """Rows ``doc_id, n_words, n_removed, text``, one for each input row.

    Words are runs of characters other than ASCII white space, unchanged.  A
    word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller id; windows are judged on the input.
    ``text`` has the words that stay, joined by one blank.

    Texts are written once, in chunk files, and every later pass is by chunk,
    so that no text is shuffled.  Texts that have all their words in common
    with an earlier one (by a 128-bit digest) go whole.  Of the others pass 1
    gives each chunk's count-min sketch of window anchors (see ``anchors``),
    cut into shards of counters; each shard is merged by one task, which tells
    every chunk the ones of its own counters that are above 1.  An estimate is
    never too small, so pass 2, which groups the windows estimated repeated by
    a 96-bit hash of their words, loses none.  The sketch has 2**bits counters
    a row, by the size of the input without a limit; it is nowhere held whole.

    Null and empty texts have no words; very long ones are taken whole, in a
    chunk of their own.  Rows with a null id are neither cut nor a reason to
    cut.  Rows that repeat an id do not cut each other.  Empty tables give
    empty results; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = scratch(spark, "chunks")
    index = stored(rows.mapInArrow(_stower(folder), INDEX_SCHEMA), "chunk-index")
    size, chunks = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_distinct("chunk")).first()
    if bits is None:
        bits = max(MIN_BITS, int(np.ceil(np.log2(max(size, 1) / COUNTER_BYTES))))
    shard_bits = min(bits, MAX_SHARD_BITS, max(SHARD_BITS, bits - SHARDS))
    tasks = int(np.clip(chunks, 1, 50_000))

    def told(*others: DataFrame) -> DataFrame:
        """Messages to chunks, each chunk's together and by row."""
        out = here
        for o in others:
            out = out.unionByName(o, allowMissingColumns=True)
        return out.repartition(tasks, "chunk").sortWithinPartitions("chunk", "row")

    here = index.filter("row = 0").select("chunk", F.lit(_HERE).alias("row"), F.lit(_HERE).alias("at"), F.lit(None).cast("binary").alias("hits"))
    whole = index.filter((F.col("words") >= window) & F.col("doc_id").isNotNull())
    least = whole.groupBy("f0", "f1").agg(F.min("doc_id").alias("least")).select(again("f0").alias("f0"), "f1", "least")
    gone = stored(whole.join(least, ["f0", "f1"]).filter("doc_id > least").select("chunk", "row", F.lit(-1).alias("at")), "copies")

    sketches = told(gone).mapInArrow(_sketcher(folder, window, bits, shard_bits), "shard int, chunk long, once binary, more binary")
    shards = DEPTH << (bits - shard_bits)
    merged = sketches.repartition(min(shards, 50_000), "shard").sortWithinPartitions("shard").mapInArrow(_merger(shard_bits), TOLD_SCHEMA)
    windows = told(gone, merged).mapInArrow(_emitter(folder, window, bits, shard_bits), "k0 long, k1 int, doc_id long, chunk long, row int, at int")
    windows = stored(windows, "windows")
    first = windows.groupBy("k0", "k1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    first = first.select(again("k0").alias("k0"), "k1", "first")
    marks = windows.join(first, ["k0", "k1"]).filter("doc_id > first").select("chunk", "row", "at")
    return told(gone, marks).mapInArrow(_cutter(folder, window), "doc_id long, n_words long, n_removed long, text string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages of earlier ones."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
