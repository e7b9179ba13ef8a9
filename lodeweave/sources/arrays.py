"""`.npy` matrices as a partitioned table: ranges of rows read on their own, keys from the path, and the writer for it.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("npy").option("path", root).option("keys", "dataset,embedder").load()

gives one row for each matrix row: file, row, the keys (from folders `dataset=name`), vector. The matching writer takes
vector and puts each task's rows into one file below root, or, with a column file, into files of those names. Paths may
carry any scheme that pyarrow's file systems open (file, hdfs, s3, gs); all nodes must reach them.
"""

from __future__ import annotations

import ast
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: How a file begins, and where the length of its header stands by version.
MAGIC = b"\x93NUMPY"
#: A partition reads about so many bytes; a batch holds so many rows.
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 1024


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def header(file) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begins) of an open file; only its header is read."""
    start = file.read(8)
    if start[:6] != MAGIC:
        raise ValueError("not an npy file")
    size, form = (2, "<H") if start[6] == 1 else (4, "<I")
    length = struct.unpack(form, file.read(size))[0]
    facts = ast.literal_eval(file.read(length).decode("latin1" if start[6] < 3 else "utf-8"))
    if facts["fortran_order"] and len(facts["shape"]) > 1:
        raise ValueError("columns first: rows can't be read by range")
    kind = np.dtype(facts["descr"])
    if kind.hasobject:
        raise ValueError("objects are not read")
    return kind, facts["shape"], 8 + size + length


def keys_of(path: str, names: list[str]) -> list[str | None]:
    """The values of folders `name=value` in a path; null where there is none."""
    held = dict(p.split("=", 1) for p in path.split("/")[:-1] if "=" in p)
    return [urllib.parse.unquote(held[n]) if n in held else None for n in names]


@dataclass
class Rows(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, keys: list[str], partition_bytes: int):
        self.path, self.keys, self.partition_bytes = path, keys, partition_bytes

    def partitions(self) -> list[Rows]:
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type != pafs.FileType.File or not f.path.endswith(".npy") or f.base_name.startswith((".", "_")):
                continue
            with fs.open_input_file(f.path) as file:
                kind, shape, _ = header(file)
            rows, width = (shape[0], int(np.prod(shape[1:]))) if shape else (1, 1)
            step = max(1, self.partition_bytes // max(1, width * kind.itemsize))
            out += [Rows(f.path, a, min(a + step, rows)) for a in range(0, rows, step)]
        return out or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.begin >= part.end:
            return
        fs, _ = _opened(self.path)
        with fs.open_input_file(part.path) as file:
            kind, shape, start = header(file)
            width = int(np.prod(shape[1:])) if len(shape) > 1 else 1
            file.seek(start + part.begin * width * kind.itemsize)
            for a in range(part.begin, part.end, BATCH_ROWS):
                n = min(BATCH_ROWS, part.end - a)
                data = np.frombuffer(file.read(n * width * kind.itemsize), kind).astype(np.float64)
                lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, data)
                names = [pa.array([k] * n, pa.string()) for k in keys_of(part.path, self.keys)]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(a, a + n)), *names, lists], ["file", "row", *self.keys, "vector"])


@dataclass
class _Written(WriterCommitMessage):
    #: hidden path and name to be of each matrix
    files: list[tuple[str, str | None]]


class _Matrix:
    """A matrix being written: its data go to a neighbour first, as the shape stands in front of them."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: np.dtype):
        self.fs, self.path, self.kind, self.rows, self.width = fs, path, kind, 0, None
        self.data = fs.open_output_stream(f"{path}.data")

    def add(self, vectors: pa.ListArray) -> None:
        flat, sizes = vectors.flatten(), np.unique(np.diff(vectors.offsets.to_numpy()))
        if vectors.null_count or flat.null_count or len(sizes) > 1 or (self.width is not None and sizes[0] != self.width):
            raise ValueError("vectors must be there, whole and of one length")
        self.width, self.rows = int(sizes[0]), self.rows + len(vectors)
        self.data.write(flat.to_numpy(zero_copy_only=False).astype(self.kind).tobytes())

    def close(self) -> None:
        self.data.close()
        with self.fs.open_output_stream(self.path) as file, self.fs.open_input_file(f"{self.path}.data") as data:
            file.write(_header(self.kind, (self.rows, self.width or 0)))
            while chunk := data.read(1 << 22):
                file.write(chunk)
        self.fs.delete_file(f"{self.path}.data")


class _Writer(DataSourceArrowWriter):
    """Each task writes hidden files; all are named once every task is done. With a column file its runs are files of those names."""

    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite, self.job = path, kind, overwrite, uuid.uuid4().hex
        if not overwrite and self._matrices():
            raise ValueError(f"there are arrays in {path} already")

    def _matrices(self) -> list[str]:
        fs, root = _opened(self.path)
        return [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".npy") and not f.base_name.startswith(".")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        files: list[tuple[str, str | None]] = []
        now: _Matrix | None = None
        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("file")).to_pylist() if "file" in batch.schema.names else [None] * batch.num_rows
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is None or names[a] != files[-1][1]:
                    if now:
                        now.close()
                    files.append((f"{root}/.{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}-{len(files):06d}.npy", names[a]))
                    now = _Matrix(fs, files[-1][0], np.dtype(self.kind))
                part = batch.slice(a, b - a)
                if "row" in part.schema.names and part.column(part.schema.get_field_index("row")).to_pylist() != list(range(now.rows, now.rows + b - a)):
                    raise ValueError("the rows of a file must come in their order")
                column = part.column(part.schema.get_field_index("vector"))
                now.add(pa.concat_arrays([column]) if column.offset == 0 else pa.array(column.to_pylist(), column.type))
        if now:
            now.close()
        return _Written(files)

    def commit(self, messages: list[_Written]) -> None:
        fs, root = _opened(self.path)
        for path in self._matrices() if self.overwrite else []:
            fs.delete_file(path)
        for k, (hidden, name) in enumerate(f for m in messages if m for f in m.files):
            fs.move(hidden, f"{root}/{name or f'part-{k:06d}.npy'}")

    def abort(self, messages: list[_Written]) -> None:
        fs, _ = _opened(self.path)
        for hidden, _ in (f for m in messages if m for f in m.files):
            if fs.get_file_info(hidden).type == pafs.FileType.File:
                fs.delete_file(hidden)


def _header(kind: np.dtype, shape: tuple[int, int]) -> bytes:
    """A file's header of version 1, padded so that data begin at a multiple of 64."""
    facts = repr({"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape}).encode()
    pad = -(len(MAGIC) + 4 + len(facts) + 1) % 64
    return MAGIC + bytes([1, 0]) + struct.pack("<H", len(facts) + pad + 1) + facts + b" " * pad + b"\n"


class ArrayFiles(DataSource):
    """Options: path; keys (comma-separated folder keys); partition_bytes; dtype of what is written (float32)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _keys(self) -> list[str]:
        return [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]

    def schema(self) -> str:
        return ", ".join(["file string", "row long", *[f"`{k}` string" for k in self._keys()], "vector array<double>"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self._keys(), int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        if "vector" not in schema.fieldNames():
            raise ValueError("arrays need a column vector")
        return _Writer(self.options["path"], self.options.get("dtype", "float32"), overwrite)


def write_embeddings(df: DataFrame, path: str, key: str, vector: str) -> None:
    """Matrices in path/arrays and path/metadata, Parquet of (file, row, key): which matrix row holds whose vector.

    The rows are first written as Parquet, whose files then become matrices one to one, in their order; so what the
    metadata says doesn't depend on how rows are dealt out in one job or another.
    """
    spark = df.sparkSession
    spark.dataSource.register(ArrayFiles)
    df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").select("key", "vector", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    names = F.regexp_replace("file", r"\.parquet$", ".npy")
    rows.select(names.alias("file"), "row", F.col("key").alias(key)).write.mode("overwrite").parquet(f"{path}/metadata")
    rows.select(names.alias("file"), "row", "vector").repartition("file").sortWithinPartitions("file", "row").write.format("npy").mode("overwrite").option("path", f"{path}/arrays").save()
