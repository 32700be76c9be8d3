"""Spark data sources for folders of array files: NPY, NPZ and Arrow IPC, read by file and row range, written as part files.

Formats after register(spark):
  npy_rows    row long, value: rows of all .npy files of a folder, numbered on in the order of the files' names
  npz_member  row long, value: the same of one member of each .npz file, the first of the option `members` that it has, else its first
  arrow_ipc   the files' own columns, with file_name string and file_row long where the option `positions` is true

Writing npy_rows takes one column, npz_member one column and the option `members` (the first name is used), arrow_ipc any
columns. Part files follow the order of the partitions; they are written beside and renamed into place when all tasks are
done, and an overwrite takes old files away after that. Tasks must reach the path: a folder that is shared, or a URI of
a file system that Arrow knows. Object arrays and arrays in column order are refused; empty folders have no schema.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a partition that is read, of a batch, and of a file that is written.
RANGE_ROWS, BATCH_ROWS, FILE_ROWS = 100_000, 1_000, 100_000


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, suffix: str) -> list[str]:
    """Files of a folder by name, or the one file; hidden ones are left out."""
    system, place = _system(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [place]
    found = [f for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_"))]
    if not found:
        raise ValueError(f"no {suffix} files in {path}")
    return [f.path for f in sorted(found, key=lambda f: f.base_name)]


def _header(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and place of the first row of an NPY file."""
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column and len(shape) > 1 or dtype.hasobject or not 1 <= len(shape) <= 2 or dtype.kind not in "fiub":
        raise ValueError("only arrays of numbers with one or two axes, in row order")
    return shape, dtype, f.tell()


def _sql_type(shape: tuple[int, ...], dtype: np.dtype) -> str:
    kind = {"f": "double", "i": "long", "u": "long", "b": "boolean"}[dtype.kind]
    return kind if len(shape) == 1 else f"array<{kind}>"


def _batch(row: int, values: np.ndarray) -> pa.RecordBatch:
    values = values.astype({"f": np.float64, "i": np.int64, "u": np.int64, "b": np.bool_}[values.dtype.kind])
    column = pa.array(values.ravel())
    if values.ndim == 2:
        column = pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], column)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(values))), column], names=["row", "value"])


@dataclass
class Range(InputPartition):
    """Rows [first, past) of a file, the first of which has number row; member of an NPZ, batches of an Arrow file."""

    path: str
    first: int
    past: int
    row: int = 0
    member: str = ""


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Range]:
        system, out, row = _system(self.path)[0], [], 0
        for p in _listed(self.path, ".npy"):
            with system.open_input_file(p) as f:
                n = _header(f)[0][0]
            out += [Range(p, a, min(n, a + RANGE_ROWS), row + a) for a in range(0, n, RANGE_ROWS)]
            row += n
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        with _system(self.path)[0].open_input_file(part.path) as f:
            shape, dtype, start = _header(f)
            width = int(np.prod(shape[1:], dtype=int))
            for a in range(part.first, part.past, BATCH_ROWS):
                n = min(BATCH_ROWS, part.past - a)
                f.seek(start + a * width * dtype.itemsize)
                values = np.frombuffer(f.read(n * width * dtype.itemsize), dtype).reshape(n, *shape[1:])
                yield _batch(part.row + a - part.first, values)


def _member(z: zipfile.ZipFile, members: list[str]) -> str:
    names = [n.removesuffix(".npy") for n in z.namelist()]
    return next((m for m in members if m in names), names[0]) + ".npy"


class NpzReader(DataSourceReader):
    """A member is compressed as a whole, so a file is one partition; it is still read batch by batch."""

    def __init__(self, path: str, members: list[str]):
        self.path, self.members = path, members

    def shapes(self) -> Iterator[tuple[str, str, tuple[int, ...], np.dtype]]:
        for p in _listed(self.path, ".npz"):
            with _system(self.path)[0].open_input_file(p) as f, zipfile.ZipFile(f) as z:
                name = _member(z, self.members)
                with z.open(name) as m:
                    shape, dtype, _ = _header(m)
                yield p, name, shape, dtype

    def partitions(self) -> list[Range]:
        out, row = [], 0
        for p, name, shape, _ in self.shapes():
            out.append(Range(p, 0, shape[0], row, name))
            row += shape[0]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with _system(self.path)[0].open_input_file(part.path) as f, zipfile.ZipFile(f) as z, z.open(part.member) as m:
            shape, dtype, _ = _header(m)
            width = int(np.prod(shape[1:], dtype=int))
            for a in range(0, part.past, BATCH_ROWS):
                n = min(BATCH_ROWS, part.past - a)
                yield _batch(part.row + a, np.frombuffer(m.read(n * width * dtype.itemsize), dtype).reshape(n, *shape[1:]))


class ArrowReader(DataSourceReader):
    """Files in file format are read batch by batch in parallel; a stream is one partition."""

    def __init__(self, path: str, positions: bool):
        self.path, self.positions = path, positions

    def _open(self, path: str):
        f = _system(self.path)[0].open_input_file(path)
        try:
            return pa.ipc.open_file(f)
        except pa.ArrowInvalid:
            f.seek(0)
            return pa.ipc.open_stream(f)

    def schema(self) -> StructType:
        own = pa.schema(self._open(_listed(self.path, ".arrow")[0]).schema)
        return from_arrow_schema(own.append(pa.field("file_name", pa.string())).append(pa.field("file_row", pa.int64())) if self.positions else own)

    def partitions(self) -> list[Range]:
        out = []
        for p in _listed(self.path, ".arrow"):
            reader = self._open(p)
            row = 0
            if isinstance(reader, pa.RecordBatchFileReader):
                for n in range(reader.num_record_batches):
                    out.append(Range(p, n, n + 1, row))
                    row += reader.get_batch(n).num_rows if self.positions else 0
            else:
                out.append(Range(p, 0, -1))
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        reader, row = self._open(part.path), part.row
        for batch in reader if part.past < 0 else (reader.get_batch(n) for n in range(part.first, part.past)):
            for a in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(a, BATCH_ROWS)
                columns, names = list(piece.columns), list(piece.schema.names)
                if self.positions:
                    columns += [pa.array([part.path.rsplit("/", 1)[-1]] * piece.num_rows, pa.string()), pa.array(np.arange(row, row + piece.num_rows))]
                    names += ["file_name", "file_row"]
                row += piece.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PartWriter(DataSourceArrowWriter):
    """Part files of at most FILE_ROWS rows, in a hidden folder until all tasks are done."""

    def __init__(self, path: str, suffix: str, overwrite: bool, member: str = "values"):
        self.path, self.suffix, self.overwrite, self.member = path, suffix, overwrite, member
        self.job = uuid.uuid4().hex

    def _hidden(self) -> str:
        return f"{_system(self.path)[1].rstrip('/')}/.job-{self.job}"

    def _content(self, table: pa.Table) -> bytes:
        out = io.BytesIO()
        if self.suffix == ".arrow":
            with pa.ipc.new_file(out, table.schema) as w:
                w.write_table(table, max_chunksize=BATCH_ROWS)
            return out.getvalue()
        if table.num_columns != 1 or table.column(0).null_count:
            raise ValueError("arrays take one column without nulls")
        column = table.column(0).combine_chunks()
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = set(column.value_lengths().to_pylist())
            if len(sizes) > 1:
                raise ValueError(f"rows of {len(sizes)} different lengths make no matrix")
            values = flat.reshape(len(column), -1)
        else:
            values = column.to_numpy(zero_copy_only=False)
        if self.suffix == ".npy":
            np.save(out, values)
        else:
            np.savez_compressed(out, **{self.member: values})
        return out.getvalue()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, names, held, rows = _system(self.path)[0], [], [], 0
        task = TaskContext.get()

        def flush() -> None:
            name = f"part-{task.partitionId():05d}-{len(names):05d}-{self.job[:8]}-{task.taskAttemptId()}{self.suffix}"
            system.create_dir(self._hidden(), recursive=True)
            with system.open_output_stream(f"{self._hidden()}/{name}") as f:
                f.write(self._content(pa.Table.from_batches(held)))
            names.append(name)

        for batch in iterator:
            if rows and rows + batch.num_rows > FILE_ROWS:
                flush()
                held, rows = [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            flush()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, place = _system(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.type == fs.FileType.File]
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{self._hidden()}/{name}", f"{place.rstrip('/')}/{name}")
        for p in old if self.overwrite else []:
            system.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system = _system(self.path)[0]
        if system.get_file_info(self._hidden()).type == fs.FileType.Directory:
            system.delete_dir(self._hidden())


class NpyRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_rows"

    def schema(self) -> str:
        path = self.options["path"]
        with _system(path)[0].open_input_file(_listed(path, ".npy")[0]) as f:
            shape, dtype, _ = _header(f)
        return f"row long, value {_sql_type(shape, dtype)}"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], ".npy", overwrite)


class NpzMember(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_member"

    def _members(self) -> list[str]:
        return [m for m in self.options.get("members", "").split(",") if m]

    def schema(self) -> str:
        _, _, shape, dtype = next(self.reader(None).shapes())
        return f"row long, value {_sql_type(shape, dtype)}"

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options["path"], self._members())

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], ".npz", overwrite, (self._members() or ["values"])[0])


class ArrowIpc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return self.reader(None).schema()

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], self.options.get("positions", "false").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        return PartWriter(self.options["path"], ".arrow", overwrite)


def register(spark: SparkSession) -> None:
    """Makes the three formats known to a session."""
    for source in (NpyRows, NpzMember, ArrowIpc):
        spark.dataSource.register(source)
