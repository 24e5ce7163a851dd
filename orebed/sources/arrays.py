"""Dense NumPy arrays as tables: ``.npy`` files, or folders of slabs with a sidecar.

A table has a row for each value: ``flat``, its place in C order, and
``value``.  Tasks read ranges of places by offset, and never hold more than one
slab; the driver reads headers and the sidecar only.
"""

from __future__ import annotations

import ast
import json
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import arrow_files

#: Values that a task reads or writes at a time.
SLAB_VALUES = 1 << 20
SIDECAR = "meta.json"
_MAGIC = b"\x93NUMPY"
_TYPES = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "b1": "boolean"}


@dataclass
class Header:
    dtype: np.dtype
    shape: tuple[int, ...]
    fortran: bool
    #: Bytes before the first value.
    offset: int

    @property
    def values(self) -> int:
        return math.prod(self.shape)


def parse_header(read, size: int, name: str) -> Header:
    """The header of a ``.npy`` file of ``size`` bytes; ``read(n)`` gives the next bytes.  A file that is cut off, or too long, is an error."""
    magic = read(8)
    if len(magic) < 8 or magic[:6] != _MAGIC or magic[6] not in (1, 2, 3):
        raise ValueError(f"{name} is no .npy file")
    wide = magic[6] > 1
    length = struct.unpack("<I" if wide else "<H", read(4 if wide else 2))[0]
    fields = ast.literal_eval(read(length).decode("utf-8" if magic[6] == 3 else "latin1"))
    out = Header(np.dtype(fields["descr"]), tuple(fields["shape"]), bool(fields["fortran_order"]), 8 + (4 if wide else 2) + length)
    if out.dtype.str[1:] not in _TYPES:
        raise ValueError(f"{name} holds values of type {out.dtype}")
    wanted = out.offset + out.values * out.dtype.itemsize
    if size != wanted:
        raise ValueError(f"{name} has {size} bytes instead of {wanted}: it is cut off or damaged")
    return out


@dataclass
class _Slab(InputPartition):
    path: str
    offset: int
    start: int
    count: int

    def __init__(self, path: str, offset: int, start: int, count: int):
        super().__init__(None)
        self.path, self.offset, self.start, self.count = path, offset, start, count


def _described(path: str, step: int = SLAB_VALUES) -> tuple[Header, list[_Slab]]:
    """What is at a path, a file or a folder, and the slabs to read it by: for a file of ``step`` values."""
    files, place = arrow_files(path)
    info = files.get_file_info(place)
    if info.is_file:
        with files.open_input_file(place) as f:
            h = parse_header(f.read, info.size, path)
        return h, [_Slab(path, h.offset + k * h.dtype.itemsize, k, min(step, h.values - k)) for k in range(0, h.values, step)]
    sidecar = files.get_file_info(f"{place}/{SIDECAR}")
    if not sidecar.is_file:
        raise FileNotFoundError(f"no array at {path}")
    with files.open_input_file(f"{place}/{SIDECAR}") as f:
        meta = json.loads(f.read())
    h = Header(np.dtype(meta["dtype"]), tuple(meta["shape"]), False, 0)
    from pyarrow import fs

    sizes = {x.base_name: x.size for x in files.get_file_info(fs.FileSelector(place))}
    slabs, step = [], meta["slab_values"]
    for k in range(0, h.values, step):
        name, count = f"{meta['generation']}-{k // step:08d}.bin", min(step, h.values - k)
        if sizes.get(name) != count * h.dtype.itemsize:
            raise ValueError(f"{path}/{name} is missing or cut off")
        slabs.append(_Slab(f"{path.rstrip('/')}/{name}", 0, k, count))
    return h, slabs


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, step: int):
        self.header, self.slabs = _described(path, step)

    def partitions(self) -> list[InputPartition]:
        return self.slabs

    def read(self, partition: _Slab) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an array without values has no slabs
            return
        h = self.header
        files, place = arrow_files(partition.path)
        with files.open_input_file(place) as f:
            f.seek(partition.offset)
            data = f.read(partition.count * h.dtype.itemsize)
        if len(data) != partition.count * h.dtype.itemsize:
            raise ValueError(f"{partition.path} is cut off")
        values = np.frombuffer(data, h.dtype)
        values = values.astype(np.int16) if h.dtype.str[1:] == "u1" else values.astype(h.dtype.newbyteorder("="))
        flat = np.arange(partition.start, partition.start + partition.count)
        if h.fortran:
            flat = np.ravel_multi_index(np.unravel_index(flat, h.shape, order="F"), h.shape)
        for k in range(0, len(values), 65_536):
            yield pa.record_batch([pa.array(flat[k : k + 65_536], pa.int64()), pa.array(values[k : k + 65_536])], names=["flat", "value"])


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Writes rows ``slab, flat, value`` that are together and in order by slab; a null flat only says that the slab exists."""

    def __init__(self, options: dict):
        self.path, self.dtype = options["path"].rstrip("/"), np.dtype(options["dtype"])
        self.shape, self.fill = tuple(json.loads(options["shape"])), float(options["fill"])
        self.meta, self.step = json.loads(options.get("meta", "{}")), int(options["slabvalues"])
        self.generation = uuid.uuid4().hex[:12]

    def _put(self, slab: int, held: list[pa.RecordBatch]) -> str:
        total = math.prod(self.shape)
        count = min(self.step, total - slab * self.step)
        out = np.full(count, self.fill if self.dtype.kind == "f" else int(self.fill), self.dtype)
        t = pa.Table.from_batches(held)
        t = t.filter(pa.compute.is_valid(t.column("flat")))
        at = t.column("flat").to_numpy() - slab * self.step
        if len(at) and (at.min() < 0 or at.max() >= count or np.bincount(at, minlength=1).max() > 1):
            raise ValueError(f"a place of slab {slab} is outside the array or has two values")
        values = t.column("value").cast(pa.float64() if self.dtype.kind == "f" else pa.int64())
        empty = values.is_null().to_numpy()
        out[at[~empty]] = values.drop_null().to_numpy().astype(self.dtype)
        name = f"{self.generation}-{slab:08d}.bin"
        files, place = arrow_files(f"{self.path}/{name}")
        files.create_dir(place.rpartition("/")[0], recursive=True)
        hidden = f"{place}.{uuid.uuid4().hex}.tmp"
        with files.open_output_stream(hidden, compression=None) as f:
            f.write(out.tobytes())
        files.move(hidden, place)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        names, held, slab = [], [], None
        for batch in iterator:
            ids, start = batch.column("slab").to_numpy(), 0
            while start < len(ids):
                end = start + int(np.searchsorted(ids[start:], ids[start], "right"))
                if slab is not None and ids[start] != slab:
                    names.append(self._put(slab, held))
                    held = []
                slab = int(ids[start])
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            names.append(self._put(slab, held))
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The sidecar names this generation's slabs: the array changes when it is renamed into place."""
        from pyarrow import fs

        wanted = -(-math.prod(self.shape) // self.step)
        if sum(len(m.names) for m in messages if m) != wanted:
            raise ValueError(f"{wanted} slabs were to be written")
        files, place = arrow_files(self.path)
        files.create_dir(place, recursive=True)
        meta = self.meta | {"shape": list(self.shape), "dtype": self.dtype.str, "order": "C", "slab_values": self.step, "generation": self.generation}
        with files.open_output_stream(f"{place}/{SIDECAR}.tmp", compression=None) as f:
            f.write(json.dumps(meta, indent=2).encode())
        files.move(f"{place}/{SIDECAR}.tmp", f"{place}/{SIDECAR}")
        for x in files.get_file_info(fs.FileSelector(place)):
            if x.is_file and x.base_name != SIDECAR and not x.base_name.startswith(self.generation):
                files.delete_file(x.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place = arrow_files(self.path)
        for m in messages:
            for name in m.names if m else []:
                files.delete_file(f"{place}/{name}")


class ArraySource(DataSource):
    """The format ``dense``: see the module."""

    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        header, _ = _described(self.options["path"])
        return f"flat long, value {_TYPES[header.dtype.str[1:]]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options["path"], int(self.options.get("slabvalues", SLAB_VALUES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArrayWriter(dict(self.options))


def array_shape(path: str) -> tuple[int, ...]:
    return _described(path)[0].shape


def read_array(spark: SparkSession, path: str, dims: tuple[str, ...] | None = None, slab_values: int = SLAB_VALUES) -> DataFrame:
    """The values of an array, a row each, with a column for each dimension and ``value``.
    A task reads ``slab_values`` of a file at a time.

    Without ``dims`` three dimensions are ``ix, iy, iz`` and four ``real_id``
    before them; where these three come last, ``cell_id`` is their place
    ``(ix * ny + iy) * nz + iz``.  A file that is cut off is an error.
    """
    spark.dataSource.register(ArraySource)
    shape = array_shape(path)
    dims = dims or {3: ("ix", "iy", "iz"), 4: ("real_id", "ix", "iy", "iz")}.get(len(shape)) or tuple(f"i{k}" for k in range(len(shape)))
    if len(dims) != len(shape):
        raise ValueError(f"{len(dims)} names for {len(shape)} dimensions")
    place, columns = F.col("flat"), {}
    for name, n in reversed(list(zip(dims, shape, strict=True))):
        columns[name] = (place % n).cast("int" if name == "real_id" else "long")
        place = F.floor(place / n) if n else place
    cell = [(F.col("flat") % math.prod(shape[-3:])).alias("cell_id")] if tuple(dims[-3:]) == ("ix", "iy", "iz") else []
    return spark.read.format("dense").option("slabvalues", str(slab_values)).load(path).select(*[columns[d].alias(d) for d in dims], *cell, "value")


def write_array(df: DataFrame, path: str, shape: tuple[int, ...], dims: tuple[str, ...], value: str = "value", dtype: str = "<f4", fill: float = math.nan, axes: dict[str, list[float] | tuple[float, float]] | None = None, slab_values: int = SLAB_VALUES) -> None:
    """The rows as a dense array in C order, in slabs of so many values, each a file, with a sidecar.

    ``dims`` names a column of each dimension, or ``cell_id`` for the last
    three together.  Places without a row, and null values, hold ``fill`` (whole
    numbers need one).  Two rows at one place, or one outside the array, are an
    error.  ``axes`` are the first cell centre and step of named axes, and go
    into the sidecar as ``x_min, x_max, dx`` and so on.  The array at the path
    changes when all slabs are written, not before.
    """
    spark, step = df.sparkSession, slab_values
    spark.dataSource.register(ArraySource)
    if np.dtype(dtype).kind != "f" and math.isnan(fill):
        raise ValueError("whole numbers need a fill")
    sizes = (*shape[:-3], math.prod(shape[-3:])) if dims[-1] == "cell_id" else shape
    if len(dims) != len(sizes):
        raise ValueError(f"{len(dims)} names for {len(sizes)} dimensions")
    inside: Column = reduce(lambda a, b: a & b, [(F.col(d) >= 0) & (F.col(d) < n) for d, n in zip(dims, sizes, strict=True)])
    flat = reduce(lambda a, dn: a * dn[1] + F.col(dn[0]), zip(dims[1:], sizes[1:], strict=True), F.col(dims[0]).cast("long"))
    flat = F.when(inside, flat).otherwise(F.raise_error(F.lit("a row is outside the array")).cast("long"))
    slabs = -(-math.prod(shape) // step)
    meta = {}
    for k, (name, (start, by)) in enumerate((axes or {}).items()):
        n = shape[len(shape) - len(axes) + k]
        meta |= {f"{name}_min": float(start), f"{name}_max": float(start) + float(by) * (n - 1), f"d{name}": float(by)}
    kind = "double" if np.dtype(dtype).kind == "f" else "long"
    rows = df.select(flat.alias("flat"), F.col(value).cast(kind).alias("value")).select(F.floor(F.col("flat") / step).cast("long").alias("slab"), "flat", "value")
    every = spark.range(slabs).select(F.col("id").alias("slab"), F.lit(None).cast("long").alias("flat"), F.lit(None).cast(kind).alias("value"))
    rows = rows.unionByName(every).repartition("slab").sortWithinPartitions("slab")
    options = {"shape": json.dumps(list(shape)), "dtype": dtype, "fill": str(fill), "slabvalues": str(step), "meta": json.dumps(meta)}
    rows.write.format("dense").mode("overwrite").options(**options).save(path)


def sidecar(path: str) -> dict:
    """What is written beside a folder of slabs."""
    files, place = arrow_files(path)
    with files.open_input_file(f"{place}/{SIDECAR}") as f:
        return json.loads(f.read())


def join_slabs(path: str, out: str) -> None:
    """A folder of slabs as one ``.npy`` file, copied slab by slab."""
    header, slabs = _described(path)
    files, place = arrow_files(out)
    with files.open_output_stream(f"{place}.tmp", compression=None) as f:
        text = repr({"descr": header.dtype.str, "fortran_order": False, "shape": header.shape}).encode("latin1")
        text += b" " * (63 - (len(text) + 10) % 64) + b"\n"
        f.write(_MAGIC + b"\x01\x00" + struct.pack("<H", len(text)) + text)
        for s in slabs:
            own, name = arrow_files(s.path)
            with own.open_input_file(name) as part:
                f.write(part.read())
    files.move(f"{place}.tmp", place)
