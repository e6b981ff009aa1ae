"""Writing tensor files and raw files from DataFrames, to any place that readers reach."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.functions.dtypes import DTYPES
from loomscan.sources.files import Roots, Store, file_system
from loomscan.sources.headers import element_count, make_header

BLOCK = 8 << 20


class FileWriter:
    """One file: payload goes to a part file as it comes; the header, if there is one, is known at the end. The file is there when it is whole."""

    def __init__(self, path: str, tensors: bool, roots: Roots = None, store: Store = None):
        context = TaskContext.get()
        self.path, self.tensors, self.entries, self.size = path, tensors, [], 0
        self.system, self.place = file_system(path, roots, store)
        self.part = f"{self.place}.{context.taskAttemptId() if context else os.getpid()}.part"
        self.system.create_dir(os.path.dirname(self.place), recursive=True)
        self.handle = self.system.open_output_stream(self.part)

    def put(self, name: str | None, dtype: str | None, shape: list[int] | None, data: bytes | None) -> None:
        data = data or b""
        if self.tensors:
            if dtype not in DTYPES or element_count(tuple(shape or ())) * DTYPES[dtype].width != len(data):
                raise ValueError(f"tensor {name!r}: {len(data)} bytes are not {dtype} of shape {shape}")
            self.entries.append((name, dtype, shape or [], len(data)))
        self.handle.write(data)
        self.size += len(data)

    def close(self) -> tuple[str, int, int]:
        self.handle.close()
        header = make_header(self.entries) if self.tensors else b""
        if header:
            whole = self.part + "w"
            with self.system.open_input_stream(self.part) as source, self.system.open_output_stream(whole) as out:
                out.write(header)
                while block := source.read(BLOCK):
                    out.write(block)
            self.system.delete_file(self.part)
            self.part = whole
        self.system.move(self.part, self.place)
        return self.path, len(header), self.size


def _write(df: DataFrame, folder: str, tensors: bool, store: Store = None) -> DataFrame:
    """Rows of one file meet in one task, in order; a task writes its files one after the other and holds one row at a time."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("file", "name", "dtype", "shape", "data")]
            for file, *row in zip(*cols, strict=True):
                path = f"{root}/{file}"
                if writer is None or writer.path != path:
                    if writer:
                        done.append(writer.close())
                    writer = FileWriter(path, tensors, store=store)
                writer.put(*row)
        if writer:
            done.append(writer.close())
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.int64()), pa.array(cols[2], type=pa.int64())], names=["path", "header_bytes", "data_bytes"])

    return df.repartition("file").sortWithinPartitions("file", "idx").select("file", "name", "dtype", "shape", "data").mapInArrow(run, "path string, header_bytes bigint, data_bytes bigint")


def write_tensor_files(df: DataFrame, folder: str, store: Store = None) -> list[tuple[str, int, int]]:
    """Write rows (file, idx, name, dtype, shape, data) as tensor files below a shared folder; (path, header bytes, data bytes) of each file."""
    return sorted((r[0], r[1], r[2]) for r in _write(df, folder, True, store).collect())


def write_raw_files(df: DataFrame, folder: str, store: Store = None) -> list[tuple[str, int, int]]:
    """Write rows (file, idx, data) as files of the bytes one after the other."""
    rows = df.select("file", "idx", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("dtype"), F.lit(None).cast("array<bigint>").alias("shape"), "data")
    return sorted((r[0], r[1], r[2]) for r in _write(rows, folder, False, store).collect())


def float_bytes(values):
    """The column's array of floats as little-endian bytes."""

    @F.pandas_udf("binary")
    def pack(rows):
        import numpy as np

        return rows.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return pack(values)
