"""Iterators over scans, for callers that take tensors or chunks one by one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.functions.dtypes import DTYPES
from loomscan.operators import scan
from loomscan.plans import folds
from loomscan.sources.options import Options


@dataclass(frozen=True)
class FileChunks:
    """A request: chunks of the given sizes, one after the other from an offset of a file."""

    id: int
    path: str
    offset: int
    chunks: list[int]

    def total_size(self) -> int:
        return sum(self.chunks)

    def max_chunk_size(self) -> int:
        return max(self.chunks, default=0)


def as_array(data: bytes, dtype: str, shape: list[int]):
    """The tensor as a numpy array, where numpy has the type; 16- and 8-bit floats widen to 32 bits, a packed type stays bytes."""
    import numpy as np

    plain = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "<u1", "BOOL": "?", "C64": "<c8", "F4": "<u1"}
    if dtype in plain:
        return np.frombuffer(data, dtype=plain[dtype]).reshape(shape)
    return np.array(DTYPES[dtype].decode(data), dtype="<f4").reshape(shape)


class _Streamer:
    """roots and store say where URIs lie; options are those of the readers."""

    def __init__(self, spark: SparkSession, roots: dict[str, str] | None = None, store: dict[str, str] | None = None, **options):
        self.spark, self.roots, self.store, self.options, self.started = spark, roots, store, options, None

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.started = None

    def _started(self):
        if self.started is None:
            raise ValueError("nothing is streamed yet")
        return self.started


class TensorStreamer(_Streamer):
    """stream_file(s), then get_tensors: (name, array) of every tensor, a partition at a time, in no promised order."""

    def stream_file(self, path: str) -> None:
        self.stream_files([path])

    def stream_files(self, paths: list[str]) -> None:
        """Headers are read and checked here, by tasks; truncated data shows while iterating."""
        self.catalog = scan.tensor_catalog(self.spark, paths, self.roots, self.store)
        self.catalog.agg(F.count("*")).collect()
        self.started = scan.tensors(self.spark, paths, self.roots, store=self.store, **self.options)

    def get_tensors(self) -> Iterator:
        for r in self._started().select("name", "dtype", "shape", "data").toLocalIterator(prefetchPartitions=True):
            yield r["name"], as_array(bytes(r["data"]), r["dtype"], r["shape"])


class ChunkStreamer(_Streamer):
    """stream_files(requests), then get_chunks: (request id, chunk number, bytes) of every chunk.

    Chunks come in rounds of at most memory_limit bytes (an option, or LOOMSCAN_MEMORY_LIMIT), one round after the other is read.
    """

    def stream_files(self, requests: list[FileChunks]) -> None:
        rows = []
        for r in requests:
            at = r.offset
            for i, n in enumerate(r.chunks):
                rows.append((r.id, r.path, i, at, n))
                at += n
        total, largest = sum(r.total_size() for r in requests), max((r.max_chunk_size() for r in requests), default=0)
        self.limit = Options.read(given={k: str(v) for k, v in self.options.items()}).request_limit(total, largest)
        self.started = self.spark.createDataFrame(rows, "file_id bigint, path string, chunk_idx int, offset bigint, size bigint")
        self.n_rounds = 1
        if self.limit < total:
            self.started = folds.pack_requests(self.started, self.limit)
            self.n_rounds = 1 + self.started.agg(F.max("request_id")).first()[0]

    def rounds(self) -> Iterator[DataFrame]:
        """The chunks of each round, with their bytes."""
        manifest = self._started()
        for i in range(self.n_rounds):
            own = manifest.filter(F.col("request_id") == i) if self.n_rounds > 1 else manifest
            yield scan.read_chunks(own, self.roots, store=self.store, **self.options)

    def get_chunks(self) -> Iterator[tuple[int, int, bytes]]:
        for rows in self.rounds():
            for r in rows.select("file_id", "chunk_idx", "data").toLocalIterator():
                yield r["file_id"], r["chunk_idx"], bytes(r["data"])
