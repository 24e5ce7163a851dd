"""Small files on any Hadoop file system, and PyArrow's view of the same paths for tasks."""

from __future__ import annotations

import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _path(spark, path)
    return files.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is no such file.  One whose checksum is wrong is a ValueError."""
    p, files = _path(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    except Py4JJavaError as e:
        if "ChecksumException" in str(e.java_exception.getClass().getName()):
            raise ValueError(f"{path} is damaged") from e
        raise
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The text under the name, whole or not at all: written beside it, then renamed over it."""
    p, files = _path(spark, path)
    hidden, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(hidden, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(hidden), context.makeQualified(p), how)


def delete(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.delete(p, True)


def arrow_files(uri: str) -> tuple[Any, str]:
    """PyArrow's file system and path for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
