"""Token counts through a digest cache."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import exists, pick, scratch, table

CACHE_SCHEMA = "digest binary, n_tokens long"


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer version, each digest once; None if there are none."""
    path = f"{cache}/version={version}"
    if not exists(spark, path):
        return None
    # Two runs that append at once can store a digest twice, with the same count.
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens``, one for each input row.

    A text's key is the SHA-256 of its UTF-8 bytes together with the SHA-256 of
    the tokenizer file, the library's version and its options; content is
    normalised in that a null text is an empty one.  Only distinct texts whose key the
    cache lacks are encoded; their counts are appended to the cache (Parquet,
    a folder for each tokenizer version), and every row takes its count from it.

    Null texts count as empty: 0 bytes, 0 tokens.  Null and repeated ids keep
    their rows.  An empty table gives an empty result.  Whole texts are
    encoded, of any length.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    version = tokens.version_digest(tokenizer)
    rows = pick(docs, doc_id=id_column, text=text_column).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # Keys only: copies collapse on the map side, however many there are.
    lacking = rows.select("digest", "text").distinct()
    known = read_cache(spark, cache, version)
    if known is not None:
        lacking = lacking.join(known, "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            counts = [len(enc.encode(texts[i].as_py())) // 4 for i in range(batch.num_rows)]
            yield pa.record_batch([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    lacking.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(f"{cache}/version={version}")
    known = read_cache(spark, cache, version).select(F.concat("digest", F.lit(b"")).alias("digest"), "n_tokens")
    light = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return light.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document by byte_bpe_50k.json, with a new cache."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    counted = count_tokens(table(spark, sf_dir, "documents"), path, scratch(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
