"""Token ids in a binary format of compressed byte or bit planes.

A shard file holds, in order: the magic ``OBPL1\\n``; the chunks, each the
planes of one block of ids, each plane compressed with zstandard; the footer,
compressed as well; its length (8 bytes) and the magic again.  The footer has
the chunk index (for each chunk its place, number of ids and plane lengths)
and the document index (id, whether it is null, number of ids).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import committed, file_system, pick, scratch, stored, table

MAGIC = b"OBPL1\n"
BLOCK_IDS = 1 << 16
LEVEL = 3
#: Ids, and documents, after which a writer begins the next shard.
SHARD_IDS, SHARD_DOCS = 1 << 24, 1 << 20
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Plane k has byte k (or bit k) of every id, lowest first."""
    lanes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        bits = np.unpackbits(lanes, axis=1, bitorder="little")
        return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]
    return [lanes[:, k].tobytes() for k in range(4)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        lanes = np.packbits(bits, axis=1, bitorder="little")
    else:
        lanes = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(lanes).view("<u4").ravel()


class Writer:
    """Writes one shard to a stream, a block at a time."""

    def __init__(self, out, kind: str = "byte", block: int = BLOCK_IDS):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.chunks: list[list] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.held_bytes += len(ids)
        if self.held_bytes >= 4 * self.block:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        data = b"".join(self.held)
        step, end = 4 * self.block, len(data) if whole else len(data) - len(data) % (4 * self.block)
        for a in range(0, end, step):
            ids = np.frombuffer(data, "<u4", count=min(step, end - a) // 4, offset=a)
            planes = [self.pack(p) for p in to_planes(ids, self.kind)]
            self.chunks.append([self.at, len(ids), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.held, self.held_bytes = [data[end:]], len(data) - end

    def close(self) -> int:
        self._flush(whole=True)
        foot = {"kind": self.kind, "chunks": self.chunks, "ids": self.ids, "sizes": self.sizes}
        data = self.pack(json.dumps(foot).encode())
        self.out.write(data + len(data).to_bytes(8, "little") + MAGIC)
        return sum(self.sizes)


def read_shard(uri: str) -> Iterator[tuple[int | None, bytes]]:
    """Each document of a shard and its ids, one chunk in memory at a time."""
    import zstandard

    files, path = file_system(uri)
    with files.open_input_file(path) as f:
        unpack = zstandard.ZstdDecompressor().decompress
        size = f.size()
        tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        n = int.from_bytes(tail[:8], "little")
        foot = json.loads(unpack(f.read_at(n, size - 8 - len(MAGIC) - n)))
        chunks = iter(foot["chunks"])
        held, at = b"", 0
        for doc_id, count in zip(foot["ids"], foot["sizes"], strict=True):
            parts, need = [], 4 * count
            while need:
                if at == len(held):
                    place, ids, *lengths = next(chunks)
                    planes = []
                    for k in lengths:
                        planes.append(unpack(f.read_at(k, place)))
                        place += k
                    held, at = from_planes(planes, ids, foot["kind"]).tobytes(), 0
                part = held[at : at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield doc_id, b"".join(parts)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, kind: str = "byte", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode whole texts, append the end id, and write shards in ascending order of id.

    Returns one row for each shard: ``shard, path, n_docs, n_tokens, base`` with
    ``base`` the ids in all shards before it.  Rows are dealt out by ranges of
    (id, hash of the text), so ties and repeated ids spread; a task begins a
    new shard after SHARD_IDS ids or SHARD_DOCS documents, so that shards have
    a bounded size at any number of partitions.  Null ids come first.  Null
    texts count as empty and hold the end id alone; very long ones go whole
    into one shard.  An empty table writes no shard.  Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        enc, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        todo = ((b.column("doc_id")[i].as_py(), b.column("text")[i].as_py()) for b in batches for i in range(b.num_rows))
        row = next(todo, None)
        while row is not None:
            path, n_ids = f"{folder}/shard-{part:06d}-{k:06d}.planes", 0
            with committed(path) as out:
                to = Writer(out, kind)
                while row is not None and n_ids < SHARD_IDS and len(to.ids) < SHARD_DOCS:
                    data = enc.encode(row[1]) + end
                    to.add(row[0], data)
                    n_ids += len(data) // 4
                    row = next(todo, None)
                total = to.close()
            yield pa.RecordBatch.from_pydict({"shard": [part << 32 | k], "path": [path], "n_docs": [len(to.ids)], "n_tokens": [total]})
            k += 1

    written = stored(rows.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "shards")
    # One task over one short row for each shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` from shard files, a task for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in read_shard(path):
                    rows.append((doc_id, base, len(ids) // 4, zlib.crc32(ids)))
                    base += len(ids) // 4
                    if len(rows) == 20_000:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    tasks = max(1, min(shards.count(), 50_000))
    return shards.select("path", "base").repartition(tasks, "path").mapInArrow(read, READ_SCHEMA)


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as byte planes and read back from the files."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), path, scratch(spark, "planes")))
