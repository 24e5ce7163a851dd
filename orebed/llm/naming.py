"""Exact deduplication by naming blocks: DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import again, pick, stored, table

BLOCK_BYTES = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is.  Where a text has only ASCII, lower() does the same and faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def block_hashes(block: Column, seed: int) -> list[Column]:
    """Two 64-bit hashes by which a place finds its block's name; see ``names_of_texts``."""
    return [F.xxhash64(F.lit(2 * seed + 1), block), F.xxhash64(F.lit(2 * seed + 2), block)]


def ranked(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """A stored table of the distinct rows with ``name``, their place in the order of the keys from 0.

    Ranges are sorted apart; a row's place is that in its range and the size of
    all ranges before, which are as few as there are partitions."""
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, what).withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    name = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(parts), "part").select(*rows.columns, name.alias("name"))


def names_of_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, hashes: Callable[[Column, int], list[Column]] = block_hashes) -> DataFrame:
    """A stored table ``row, doc_id, sha256, blocks, name``: equal texts, and only they, have
    equal (blocks, name).

    Distinct blocks are sorted, by two 64-bit hashes, and numbered: a block's
    integer name, which depends on the corpus alone, not on partitions.
    Adjacent pairs of names are then sorted and numbered in the same way, level
    by level, until one name is left for each document.

    A place finds its block's name by the two hashes, not by the bytes, which
    so are moved only once.  That two different blocks share both hashes is
    tested for over all names; then naming begins anew with other seeds.  So no
    name depends on luck.
    """
    rows = pick(docs, doc_id=id_column, text=text_column).withColumn("text", lower_ascii(F.coalesce("text", F.lit(""))))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")

    def per_block(make: Callable[[Column], Column]) -> Column:
        # The bytes are bound to a variable: written inside, they would be made anew for every block.
        blocks = F.transform(F.array(F.encode("text", "UTF-8")), lambda data: F.transform(F.sequence(F.lit(0), count - 1), lambda i: make(F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))))
        return blocks[0]

    distinct = rows.select(F.explode(per_block(lambda b: b)).alias("block")).distinct()
    seed = 0
    while True:
        h = hashes(F.col("block"), seed)
        found = stored(distinct.select(h[0].alias("h0"), h[1].alias("h1")), "block-hashes")
        if found.groupBy("h0", "h1").count().filter("count > 1").isEmpty():
            break
        seed += 1
    names = ranked(found, ["h0", "h1"], "block-names")
    marks = per_block(lambda b: F.struct(*[c.alias(f"h{k}") for k, c in enumerate(hashes(b, seed))]))
    light = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("sha256"), count.alias("blocks"), marks.alias("marks")
    )
    light = stored(light, "block-places")
    short = light.filter("blocks = 1").select("row", "doc_id", "sha256", "blocks", F.col("marks")[0]["h0"].alias("h0"), F.col("marks")[0]["h1"].alias("h1"))
    short = short.join(names, ["h0", "h1"]).select("row", "doc_id", "sha256", "blocks", "name")

    # The bound on the number of levels: a count, of the longest text only.
    longest = light.agg(F.max("blocks")).first()[0] or 1
    if longest == 1:
        return stored(short, "names")
    places = light.filter("blocks > 1").select("row", F.posexplode("marks").alias("place", "mark"))
    level = places.select("row", "place", F.col("mark.h0").alias("h0"), F.col("mark.h1").alias("h1")).join(names, ["h0", "h1"]).select("row", "place", "name")
    while longest > 1:
        half = F.col("place") % 2
        pairs = level.groupBy("row", F.floor(F.col("place") / 2).cast("int").alias("place")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = stored(pairs, "pairs")
        named = ranked(stored(pairs.select("a", "b").distinct(), "pair-kinds"), ["a", "b"], "pair-names")
        level = pairs.join(named, ["a", "b"]).select("row", "place", "name")
        longest = (longest + 1) // 2
    long = light.filter("blocks > 1").select("row", "doc_id", "sha256", "blocks").join(level.select("row", "name"), "row")
    return stored(short.unionByName(long), "names")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, hashes: Callable[[Column, int], list[Column]] = block_hashes) -> DataFrame:
    """Rows ``doc_id, keep_id, group_size, kept, text_sha256``, one for each input row.

    Texts are equal when identical after lower-casing A-Z alone; null texts
    are empty, and equal to empty ones.  Of equal texts the row with the
    largest id stays, a null id being the smallest; of rows that tie, one.
    Texts of any length are taken whole.  Empty tables give empty results;
    other columns are ignored.
    """
    names = names_of_texts(docs, id_column, text_column, block_bytes, hashes)
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = names.groupBy("name", "blocks").agg(best, F.count(F.lit(1)).alias("group_size"))
    groups = groups.select(again("name").alias("name"), "blocks", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    joined = names.join(groups, ["name", "blocks"])
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the equal one that stays."""
    return exact_groups(table(spark, sf_dir, "documents"))
