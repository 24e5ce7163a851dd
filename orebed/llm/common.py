"""What the operators of this subpackage share: picking columns, scratch tables, joins back."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, shared_dir, stored

__all__ = ["again", "committed", "dropped", "exists", "file_system", "pick", "scratch", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under new names; other columns may be called anything,
    also like one of these in another case."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_{names.index(c)}").alias(new) for new, c in columns.items()])


def dropped(spark: SparkSession, *paths: str | None) -> None:
    """Delete scratch folders that nothing reads any more."""
    for path in filter(None, paths):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def again(column: str) -> Column:
    """The same long in a new expression.  An aggregate is already dealt out by its keys, and a
    join on them would move only the other side, whose hot keys then stay in one task; a
    join on this moves both sides, which adaptive execution can split."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def file_system(uri: str) -> tuple[Any, str]:
    """PyArrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def committed(uri: str) -> Iterator[Any]:
    """A stream whose bytes appear under the name only when all are written; a second
    attempt at a task writes the same bytes again."""
    files, path = file_system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    hidden = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with files.open_output_stream(hidden, compression=None) as out:
            yield out
        files.move(hidden, path)
    except BaseException:
        with contextlib.suppress(Exception):
            files.delete_file(hidden)
        raise

