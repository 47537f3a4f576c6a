"""NetCDF classic files as tables, read in slabs by Spark's tasks.

A row is a cell: an index column for each dimension (``i_<name>``), and a column for each variable, which repeats along the
dimensions that it lacks. Attributes are the columns' metadata. Each task reads its own range of cells from the file, in
batches, and no variable but those asked for. The three classic formats are read (32-bit and 64-bit offsets, 64-bit
data), with record variables. Files are opened by path, so executors need to see them, as on a mounted file system.
"""

from __future__ import annotations

import glob
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gyre.shipping import ship

#: Cells of a task and of a batch.
CELLS, BATCH = 1_000_000, 65_536
# The tags of the header's lists, and the types by their number.
_DIMENSION, _VARIABLE, _ATTRIBUTE = 10, 11, 12
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_SPARK = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f4": T.FloatType(), "f8": T.DoubleType()}


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    dtype: np.dtype
    begin: int
    record: bool

    @property
    def packed(self) -> bool:
        return "scale_factor" in self.attributes or "add_offset" in self.attributes

    def spark_type(self) -> T.DataType:
        return T.DoubleType() if self.packed else _SPARK[self.dtype.str[1:]]


class Header:
    """The header of a classic file: dimensions, attributes, and variables with their places."""

    def __init__(self, path: str):
        with open(path, "rb") as self._file:
            magic = self._file.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path}: not a NetCDF classic file")
            self._wide, self._offset = magic[3] == 5, "i" if magic[3] == 1 else "q"
            records = self._file.read(8 if self._wide else 4)
            self.path, streaming = path, records in (b"\xff" * 4, b"\xff" * 8)
            n_records = 0 if streaming else int.from_bytes(records, "big")
            self.dims = self._list(_DIMENSION, lambda: (self._name(), self._size()))
            self.record = next((i for i, (_, n) in enumerate(self.dims) if n == 0), None)
            self.attributes = self._attributes()
            self.variables = {v.name: v for v in self._list(_VARIABLE, self._variable)}
        of_records = [v for v in self.variables.values() if v.record]
        sizes = [int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * v.dtype.itemsize for v in of_records]
        # A single record variable stands without padding.
        self.stride = sizes[0] if len(sizes) == 1 else sum(-(-n // 4) * 4 for n in sizes)
        if self.record is not None:
            if streaming and self.stride:
                n_records = (_file_size(path) - min(v.begin for v in of_records)) // self.stride
            self.dims[self.record] = (self.dims[self.record][0], n_records)

    def _int(self, code: str) -> int:
        return struct.unpack(f">{code}", self._file.read(struct.calcsize(code)))[0]

    def _size(self) -> int:
        return self._int("q" if self._wide else "i")

    def _name(self) -> str:
        n = self._size()
        return self._file.read(-(-n // 4) * 4)[:n].decode()

    def _list(self, tag: int, item) -> list:
        found, n = self._int("i"), self._size()
        if found not in (0, tag) or (not found and n):
            raise ValueError(f"{self._file.name}: malformed header")
        return [item() for _ in range(n)]

    def _attributes(self) -> dict:
        return dict(self._list(_ATTRIBUTE, self._attribute))

    def _attribute(self) -> tuple[str, object]:
        name, dtype, n = self._name(), np.dtype(_TYPES[self._int("i")]), self._size()
        raw = self._file.read(-(-n * dtype.itemsize // 4) * 4)[: n * dtype.itemsize]
        if dtype.kind == "S":
            return name, raw.decode("utf-8", "replace").rstrip("\0")
        values = np.frombuffer(raw, dtype).tolist()
        return name, values[0] if len(values) == 1 else values

    def _variable(self) -> Variable:
        name = self._name()
        dims = tuple(self._size() for _ in range(self._size()))
        attributes, dtype = self._attributes(), np.dtype(_TYPES[self._int("i")])
        self._size()  # the size in bytes, which follows from the dimensions
        return Variable(name, dims, attributes, dtype, self._int(self._offset), bool(dims) and dims[0] == self.record)

    def chosen(self, names: list[str] | None) -> list[Variable]:
        """The variables of these names; without names the widest one of numbers, and all that go along some of its dimensions."""
        if names:
            if missing := [n for n in names if n not in self.variables]:
                raise ValueError(f"{self.path}: no such variables: {missing}")
            return [self.variables[n] for n in names]
        numbers = [v for v in self.variables.values() if v.dtype.kind != "S"]
        widest = max(numbers, key=lambda v: len(v.dims), default=None)
        return [v for v in numbers if set(v.dims) <= set(widest.dims)]

    def axes(self, variables: list[Variable]) -> list[int]:
        """The dimensions along which the variables go, in the file's order."""
        return sorted({d for v in variables for d in v.dims})

    def values(self, file, v: Variable, flat: np.ndarray) -> np.ndarray:
        """The values at places of a variable, counted through its dimensions."""
        if not len(flat):
            return np.zeros(0, v.dtype)
        inner = int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) if v.record else 0
        rows, at = (flat // inner, flat % inner) if v.record else (np.zeros_like(flat), flat)
        out = np.empty(len(flat), v.dtype)
        for row in np.unique(rows):
            here = rows == row
            low, high = int(at[here].min()), int(at[here].max())
            file.seek(v.begin + int(row) * self.stride * v.record + low * v.dtype.itemsize)
            part = np.frombuffer(file.read((high - low + 1) * v.dtype.itemsize), v.dtype)
            out[here] = part[at[here] - low]
        return out


def _file_size(path: str) -> int:
    with open(path, "rb") as f:
        return f.seek(0, 2)


def _column(v: Variable, raw: np.ndarray) -> pa.Array:
    """A variable's values as a column: fill values and NaN missing, packed numbers unpacked."""
    missing = np.zeros(len(raw), bool)
    for name in ("_FillValue", "missing_value"):
        for fill in np.atleast_1d(v.attributes.get(name, [])):
            missing |= raw == np.asarray(fill).astype(v.dtype)
    out = raw.astype(raw.dtype.newbyteorder("="))
    if v.packed:
        out = out.astype(float) * v.attributes.get("scale_factor", 1.0) + v.attributes.get("add_offset", 0.0)
    if out.dtype.kind == "f":
        missing |= np.isnan(out)
    kind = v.spark_type()
    if isinstance(kind, T.DecimalType):
        return pa.array([None if m else int(x) for x, m in zip(out, missing)], pa.decimal128(20, 0))
    narrow = {T.ByteType(): "i1", T.ShortType(): "i2", T.IntegerType(): "i4", T.LongType(): "i8", T.FloatType(): "f4", T.DoubleType(): "f8"}[kind]
    return pa.array(out.astype(narrow), mask=missing)


@dataclass
class Slab(InputPartition):
    """Cells of a file, counted through its dimensions, from ``begin`` to before ``end``."""

    path: str
    begin: int
    end: int


class NetcdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.types = options, schema

    def _asked(self, header: Header) -> tuple[list[Variable], list[int], list[tuple[int, int]]]:
        """Variables, dimensions, and the range of each that is asked for."""
        variables = header.chosen(_names(self.options))
        axes = header.axes(variables)
        ranges = []
        for d in axes:
            name, n = header.dims[d]
            begin, _, end = self.options.get(f"range.{name}".lower(), ":").partition(":")
            ranges.append((int(begin or 0), min(int(end or n), n)))
        return variables, axes, ranges

    def partitions(self) -> list[Slab]:
        cells, out = int(self.options.get("cells", CELLS)), []
        for path in _files(self.options["path"]):
            _, _, ranges = self._asked(Header(path))
            n = int(np.prod([max(0, b - a) for a, b in ranges], dtype=np.int64))
            out += [Slab(path, a, min(a + cells, n)) for a in range(0, n, cells)]
        return out or [Slab("", 0, 0)]

    def read(self, slab: Slab):
        if slab.begin == slab.end:
            return
        header = Header(slab.path)
        variables, axes, ranges = self._asked(header)
        names = [f.name for f in self.types.fields]
        with open(slab.path, "rb") as file:
            for begin in range(slab.begin, slab.end, BATCH):
                places = np.arange(begin, min(begin + BATCH, slab.end))
                index = dict(zip(axes, np.unravel_index(places, [b - a for a, b in ranges]))) if axes else {}
                index = {d: i + ranges[k][0] for k, (d, i) in enumerate(index.items())}
                columns = [pa.array(index[d].astype("i4")) for d in axes]
                for v in variables:
                    shape = [header.dims[d][1] for d in v.dims]
                    flat = np.ravel_multi_index([index[d] for d in v.dims], shape) if v.dims else np.zeros_like(places)
                    columns.append(_column(v, header.values(file, v, flat)))
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _names(options: dict) -> list[str] | None:
    return [n.strip() for n in options["variables"].split(",")] if options.get("variables") else None


def _files(path: str) -> list[str]:
    found = sorted(glob.glob(path.removeprefix("file://")))
    if not found:
        raise ValueError(f"no files at {path}")
    return found


class Netcdf(DataSource):
    """``netcdf``: options path (with wildcards), variables, cells (of a task), and range.<dimension> as begin:end."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> T.StructType:
        header = Header(_files(self.options["path"])[0])
        variables = header.chosen(_names(self.options))
        plain = lambda v: {k: x for k, x in v.attributes.items() if isinstance(x, (str, int, float))}
        index = [T.StructField(f"i_{header.dims[d][0]}", T.IntegerType()) for d in header.axes(variables)]
        return T.StructType(index + [T.StructField(v.name, v.spark_type(), True, plain(v)) for v in variables])

    def reader(self, schema: T.StructType) -> NetcdfReader:
        return NetcdfReader(dict(self.options), schema)


def open_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None, ranges: dict[str, tuple[int, int]] | None = None, cells: int = CELLS) -> DataFrame:
    """The cells of NetCDF classic files: i_<dimension>, and the variables asked for, of slabs of the ranges of indices.

    Fill values and NaN are missing, packed numbers are unpacked; a file without cells gives no rows.
    """
    ship(spark)
    spark.dataSource.register(Netcdf)
    options = {"path": path, "cells": str(cells), **({"variables": ",".join(variables)} if variables else {})}
    options |= {f"range.{d}": f"{a}:{b}" for d, (a, b) in (ranges or {}).items()}
    df = spark.read.format("netcdf").options(**options).load()
    # Attributes are put on here: a source's own schema may come back without them.
    described = {f.name: f.metadata for f in Netcdf(options).schema().fields}
    return df.select(*[df[c].alias(c, metadata=described[c]) if described[c] else df[c] for c in df.columns])
