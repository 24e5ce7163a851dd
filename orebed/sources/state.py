"""State of a long run: realisations that are done, kept with the shape and configuration that they belong to."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_text, write_text

MANIFEST = "manifest.json"


def config_digest(config: dict | None) -> str:
    """Digest of a configuration, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(config or {}, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class RunState:
    """Done realisations of one shape and configuration; rows lie in a folder of this generation."""

    path: str
    shape: tuple[int, ...]
    config: str
    generation: str
    completed: set[int] = field(default_factory=set)

    @property
    def folder(self) -> str:
        return f"{self.path}/{self.generation}"

    def _save(self, spark: SparkSession, status: str) -> None:
        text = {"shape": list(self.shape), "config": self.config, "generation": self.generation, "completed_realizations": sorted(self.completed), "completed_count": len(self.completed), "status": status}
        write_text(spark, f"{self.path}/{MANIFEST}", json.dumps(text, indent=2))

    def pending(self, wanted: list[int]) -> list[int]:
        """Of the realisations asked for those that are not done."""
        return [r for r in wanted if r not in self.completed]

    def add(self, df: DataFrame, wanted: list[int] | None = None) -> None:
        """Write the realisations ``real_id`` of ``df``, then name them in the manifest: one that was cut off while it was
        written is not done.  ``wanted`` is what the run is to have in the end."""
        ids = {r["real_id"] for r in df.select(F.col("real_id").cast("int").alias("real_id")).distinct().collect()}
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("real_id").parquet(self.folder)
        self.completed |= ids
        self._save(df.sparkSession, "complete" if wanted is not None and not self.pending(wanted) else "running")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """Rows of all that is done; None if nothing is."""
        if not self.completed:
            return None
        return spark.read.parquet(self.folder).filter(F.col("real_id").isin(sorted(self.completed)))


def open_state(spark: SparkSession, path: str, shape: tuple[int, ...], config: dict | None = None) -> RunState:
    """The state at a path.  One of another shape or configuration, or whose manifest can't be read, is left
    aside: nothing is done then, and new rows go to a folder of their own."""
    path, digest = path.rstrip("/"), config_digest(config)
    try:
        found = json.loads(read_text(spark, f"{path}/{MANIFEST}") or "{}")
    except ValueError:
        found = {}
    if found.get("shape") == list(shape) and found.get("config") == digest and found.get("generation"):
        return RunState(path, tuple(shape), digest, found["generation"], set(found["completed_realizations"]))
    out = RunState(path, tuple(shape), digest, f"run-{uuid.uuid4().hex[:12]}")
    out._save(spark, "running")
    return out
