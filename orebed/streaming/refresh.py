"""Cutoff curves kept up to date while realisations arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ensemble import cutoff_curve
from ..sources.scratch import stored


def follow_curve(stream: DataFrame, path: str, checkpoint: str, cutoffs: list[float], volume: float, density: float) -> StreamingQuery:
    """The cutoff curve of each realisation, as far as its cells have come: they may arrive in any number of batches.

    A micro-batch writes its own counts and sums under ``<path>_parts``, by
    realisation and batch, then the curves of its realisations anew from these
    realisations' parts alone: work follows the batch, not all that has come.
    A batch that is run again overwrites its own part with the same.
    """
    parts = path.rstrip("/") + "_parts"

    def put(df: DataFrame, where: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(where)

    def merge(batch: DataFrame, number: int) -> None:
        own = cutoff_curve(batch, cutoffs, volume, density).select("real_id", "cutoff", "blocks", (F.col("avg_grade") * F.col("blocks")).alias("total"), F.lit(number).alias("batch"))
        own = stored(own, "arrived")
        # Realisations of one batch: a handful of numbers, which prune the folders that are read.
        touched = sorted(r["real_id"] for r in own.select("real_id").distinct().collect())
        put(own, parts, "real_id", "batch")
        held = batch.sparkSession.read.parquet(parts).filter(F.col("real_id").isin(touched))
        curve = held.groupBy("real_id", "cutoff").agg(F.sum("blocks").alias("blocks"), F.sum("total").alias("_total"))
        curve = curve.withColumn("avg_grade", F.when(F.col("blocks") > 0, F.col("_total") / F.col("blocks")).otherwise(0.0)).drop("_total")
        curve = curve.withColumn("tonnage", F.col("blocks") * (volume * density)).withColumn("contained", F.col("blocks") * (volume * density) * F.col("avg_grade") / 100)
        put(curve, path, "real_id")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
