"""Best-fit packing of tokenised documents into sequences, by merging residual bins."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import pick, stored, table

#: Pieces or bins that one best-fit call holds at most.
GROUP = 200_000
#: A bin with at most this share of its room left counts as nearly full.
SLACK = 1 / 256
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"
MOVE_SCHEMA = "bin long, parent long, place long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each size, and the fill of each bin.  The sizes come in the order given
    (largest first packs best); each goes to the open bin that it leaves least room in."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if a bin has r tokens of room
    bins, places, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, s in enumerate(sizes.tolist()):
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                mask ^= 1 << r
        else:
            b, r = len(fill), capacity
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += s
        if r > s:
            if not rooms[r - s]:
                mask |= 1 << (r - s)
            rooms[r - s].append(b)
    return bins, places, np.array(fill, np.int64)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one for each piece.

    Round 0 encodes and cuts each partition's texts and packs its pieces by
    best fit, largest first.  Bins that are nearly full stay as they are; the
    others become items, which later rounds pack in the same way, in groups of
    about ``GROUP`` items, until no two of them fit into one sequence.

    Null texts count as empty: one piece with the end id alone.  Only texts of
    more than ``capacity`` ids are cut.  Repeated and null ids keep their rows.
    An empty table gives an empty result.  Other columns are ignored.
    """
    rows = pick(docs, doc_id=id_column, text=text_column)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    nearly = capacity - int(capacity * SLACK)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        base, pieces = TaskContext.get().partitionId() << 33, []

        def flush() -> pa.RecordBatch:
            nonlocal base, pieces
            columns = [pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            sizes = columns[3].to_numpy()
            order = np.argsort(-sizes, kind="stable")
            bins, places, fill = best_fit(sizes[order], capacity)
            back = np.argsort(order)
            columns += [pa.array(x[back]) for x in (bins + base, places, fill[bins])]
            base, pieces = base + len(fill), []
            return pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "place", "fill"])

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                data = enc.encode(texts[i].as_py()) + end
                for k, a in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * a : 4 * (a + capacity)]
                    pieces.append((ids[i].as_py(), k, a, len(part) // 4, zlib.crc32(part)))
            if len(pieces) >= GROUP:
                yield flush()
        if pieces:
            yield flush()

    placed = stored(rows.mapInArrow(local, PIECE_SCHEMA), "pieces")
    items = placed.filter((F.col("place") == 0) & (F.col("fill") < nearly)).select("bin", "fill")
    moves = _merged(items, capacity, nearly)
    if moves is None:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    moves = moves.select("bin", "parent", F.col("place").alias("shift"))
    out = placed.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _merger(capacity: int, mark: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Best fit of one group's bins; parents get negative numbers that no other group or round has."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])
        bins, places, fill = best_fit(group["fill"].to_numpy(), capacity)
        parent = mark - (int(key[0]) << 24) - bins - 1
        return pd.DataFrame({"bin": group["bin"].to_numpy(), "parent": parent, "place": places, "fill": fill[bins]})

    return merge


def _open(items: DataFrame, capacity: int) -> tuple[int, np.ndarray]:
    """The largest fill with which an item still fits with the smallest other one (0 if no two fit),
    and the number of items of each fill."""
    count = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("fill").count().collect():  # at most one row for each fill up to the capacity
        count[r["fill"]] = r["count"]
    fills = np.flatnonzero(count)
    if not len(fills):
        return 0, count
    least = int(fills[0])
    # Once the smallest two do not fit, none do.
    second = least if count[least] > 1 else int(fills[1]) if len(fills) > 1 else capacity
    return (capacity - least if least + second <= capacity else 0), count


def _merged(items: DataFrame, capacity: int, nearly: int) -> DataFrame | None:
    """Rows ``bin, parent, place``: where each underfull bin of round 0 ends up.

    In odd rounds bins meet in groups dealt by hash, in even ones in groups of
    like fill: the smallest bins are one group, and if any two fit, the
    smallest two do.  So every second round merges something, and bins that
    are at most half full all but vanish.  Bins that fit with none are left out.
    """
    total: DataFrame | None = None
    stage = 1
    most, count = _open(items, capacity)
    while most:
        items = items.filter(F.col("fill") <= most)
        left = int(count[: most + 1].sum())
        groups = -(-left // GROUP)
        if groups > 1 and stage % 2 == 0:
            before = np.cumsum(count) - count
            place = F.lit(before.tolist())[F.col("fill").cast("int")] + F.pmod(F.xxhash64("bin"), F.lit(count.tolist())[F.col("fill").cast("int")])
            group = F.floor(place / GROUP)
        else:
            # Another seed in each round: bins meet others than before.
            group = F.pmod(F.xxhash64("bin", F.lit(stage)), F.lit(groups))
        dealt = items.withColumn("group", group.cast("int"))
        moves = stored(dealt.groupBy("group").applyInPandas(_merger(capacity, -(stage << 52)), MOVE_SCHEMA), f"merge-{stage}")
        if total is None:
            total = moves.select("bin", "parent", "place")
        else:
            step = moves.select(F.col("bin").alias("parent"), F.col("parent").alias("next"), F.col("place").alias("further"))
            total = total.join(step, "parent", "left").select("bin", F.coalesce("next", "parent").alias("parent"), (F.col("place") + F.coalesce("further", F.lit(0))).alias("place"))
        items = moves.filter((F.col("place") == 0) & (F.col("fill") < nearly)).select(F.col("parent").alias("bin"), "fill")
        most, count = _open(items, capacity)
        stage += 1
    return total


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens of word_bpe_49k.json."""
    return pack(table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))
