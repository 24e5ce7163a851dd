"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again before the next.  All
but the last return the columns of ``documents``.  A row with a null id or
text, repeated rows and further columns go through every stage: see the
operators for what they do with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm import decontaminate, lines, near, packing, quality, tokens
from orebed.llm.common import stored, table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose id and text are not in ``gone`` (``to_doc, to_key``); a null id is an id here."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    doc, text = F.col(f"_{names.index('doc_id')}"), F.col(f"_{names.index('text')}")
    left = plain.join(gone, doc.eqNullSafe(F.col("to_doc")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("to_key")), "left_anti")
    return left.toDF(*names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that score under 0.3.  Null and empty texts are scored like any
    others; a document without an id goes or stays by its text.  Without labels all stay."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from all documents but the one with the smallest id.

    Only the columns of the input come back, last ones that the operator adds left out by place."""
    done = lines.drop_recurring(docs)
    names = docs.columns
    return done.toDF(*[f"_{i}" for i in range(len(done.columns))]).select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at 80 percent, the document with the smallest id stays.  Documents without
    words or without an id are in no component and stay; rows that repeat an id that goes, go."""
    gone = near.near_groups(docs, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("to_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["to_doc"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, with all rows that repeat their id and text."""
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).filter("size(items) > 0")
    gone = found.select(F.col("doc_id").alias("to_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("to_key")).distinct()
    return _without(docs, gone)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 4096 tokens; null and empty texts as their end id alone."""
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("leaks", drop_leaks),
    ("packing", pack),
]

#: SQL can't express the classifier's fit; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
