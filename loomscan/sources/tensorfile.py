"""Spark data sources over tensor files and raw byte ranges.

tensorcatalog  one row for each tensor, from headers alone
tensorfile     the same rows with their bytes
bytechunks     the bytes of a chunk manifest

The driver only lists files and their sizes. Files are cut into input partitions of about partition_bytes by their sizes; a task
reads the headers of its files (two small reads each) and the tensors whose bytes begin in its part, neighbours in one request. A
value is never split. Options:

path             a file, a folder (its *.safetensors), or a glob, on disks and in stores alike
paths            JSON list of several
uri_root_map     JSON object from URI prefixes to other roots
store            JSON object of settings for object stores (loomscan.sources.storage)
partition_bytes  bytes of one input partition (default 128 MiB)
names            JSON list of tensor names; other tensors aren't read
manifest         (bytechunks) JSON list of [file_id, path, offset, [sizes]]
concurrency, block_bytes, memory_limit   as in loomscan.sources.options
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from loomscan.sources.files import Found, OpenFile, Roots, Store, file_system, glob_files, listing, parse_roots, read_blocks, remapped, scheme_of
from loomscan.sources.headers import Tensor, header_of
from loomscan.sources.options import Options

PARTITION_BYTES = 128 << 20
#: Bytes of one request, and so of one record batch, that neighbouring rows are gathered to.
BATCH_BYTES = 16 << 20
#: What a file costs besides its bytes when files are dealt to partitions, and the most parts of one.
FILE_COST = 1 << 20
CATALOG_SCHEMA = "path string, file_id bigint, tensor_idx int, name string, dtype string, shape array<bigint>, start bigint, end bigint, data_base bigint"
FILE_SCHEMA = CATALOG_SCHEMA + ", data binary"
CHUNK_SCHEMA = "file_id bigint, path string, chunk_idx int, offset bigint, size bigint, data binary"


def expand(paths: list[str], roots: Roots = None, store: Store = None) -> list[Found]:
    """Files with their sizes for paths that may be folders or globs. What isn't there has no bytes: reading it is an error."""
    found: list[Found] = []
    for p in paths:
        if any(c in p for c in "*?["):
            found += glob_files(p, roots, store)
            continue
        system, local = file_system(p, roots, store)
        info = system.get_file_info(local.rstrip("/"))
        if info.is_file:
            found.append(Found(p, info.size))
        elif p.endswith(".safetensors"):
            found.append(Found(p, 0))
        else:
            found += listing(p, allow=["*.safetensors"], roots=roots, store=store)
    return found


@dataclass
class Part(InputPartition):
    """Parts [low, high) of files, by where a tensor begins: (file_id, path, low, high). high is -1 to the end."""

    files: list[tuple[int, str, int, int]]

    def __init__(self, files: list[tuple[int, str, int, int]]):
        self.files = files


def read_rows(path: str, ranges: list[tuple[int, int]], roots: Roots, store: Store, options: Options | None = None) -> Iterator[tuple[int, int, pa.Array]]:
    """(first, last + 1, bytes) of runs of ranges: neighbours that follow each other are read as one, and their values are views of it."""
    runs: list[tuple[int, int]] = []
    at = 0
    while at < len(ranges):
        end, size = at + 1, ranges[at][1]
        while end < len(ranges) and ranges[end][0] == ranges[end - 1][0] + ranges[end - 1][1] and size + ranges[end][1] <= BATCH_BYTES:
            size += ranges[end][1]
            end += 1
        runs.append((at, end))
        at = end
    blocks = [(ranges[a][0], sum(n for _, n in ranges[a:b])) for a, b in runs]
    for (a, b), data in zip(runs, read_blocks(path, blocks, roots, store, options), strict=True):
        ends = np.cumsum([n for _, n in ranges[a:b]], dtype=np.int64)
        if ends[-1] >= 1 << 31:
            raise ValueError(f"{path}: a value of {ends[-1]} bytes is too large for a row")
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        yield a, b, pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), data])


_ARROW = [("path", pa.string()), ("file_id", pa.int64()), ("tensor_idx", pa.int32()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("start", pa.int64()), ("end", pa.int64()), ("data_base", pa.int64())]


def reader_options(options: dict, paths: list[str], roots: Roots) -> Options:
    """The settings of a scan: its own options, then the environment."""
    kind = "file" if all(scheme_of(remapped(p, roots)) == "file" for p in paths) else "object"
    return Options.read(kind, given={k: v for k, v in options.items() if k in Options.names()})


class TensorReader(DataSourceReader):
    def __init__(self, options: dict, payload: bool):
        self.roots = parse_roots(options.get("uri_root_map"))
        self.store = json.loads(options["store"]) if "store" in options else None
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]] if "path" in options else []
        self.payload = payload
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        if self.limit <= 0:
            raise ValueError("partition_bytes must be positive")
        self.names = set(json.loads(options["names"])) if "names" in options else None
        self.options = reader_options(options, self.paths, self.roots)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Equality and membership of names limit what is read; anything else is left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield f

    def partitions(self) -> list[Part]:
        """Neighbouring files together while they are small, large ones in parts of the limit."""
        parts: list[Part] = []
        now: list[tuple[int, str, int, int]] = []
        size = 0
        for file_id, f in enumerate(expand(self.paths, self.roots, self.store)):
            pieces = max(1, -(-f.size // self.limit)) if self.payload else 1
            cost = min(FILE_COST, self.limit // 16) + (f.size if self.payload else 0)
            if now and (size + cost > self.limit or pieces > 1):
                parts.append(Part(now))
                now, size = [], 0
            for i in range(pieces):
                now.append((file_id, f.path, i * self.limit, (i + 1) * self.limit if i < pieces - 1 else -1))
                if pieces > 1:
                    parts.append(Part(now))
                    now = []
            size += cost if pieces == 1 else 0
        return parts + [Part(now)] * bool(now) or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_ARROW + [("data", pa.binary())] * self.payload)
        for file_id, path, low, high in partition.files:
            with OpenFile(path, self.roots, self.store) as f:
                tensors = header_of(f)
            tensors = [t for t in tensors if low <= t.base + t.start and (high < 0 or t.base + t.start < high) and (self.names is None or t.name in self.names)]
            if self.payload:
                for a, b, data in read_rows(path, [(t.base + t.start, t.size) for t in tensors], self.roots, self.store, self.options):
                    yield pa.RecordBatch.from_arrays([*self._columns(file_id, path, tensors[a:b]), data], schema=schema)
            elif tensors:
                yield pa.RecordBatch.from_arrays(self._columns(file_id, path, tensors), schema=schema)

    @staticmethod
    def _columns(file_id: int, path: str, tensors: list[Tensor]) -> list[pa.Array]:
        rows = zip(*((path, file_id, t.index, t.name, t.dtype, t.shape, t.start, t.end, t.base) for t in tensors), strict=True)
        return [pa.array(c, type=t) for c, (_, t) in zip(rows, _ARROW, strict=True)]


class TensorCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorcatalog"

    def schema(self) -> str:
        return CATALOG_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(dict(self.options), False)


class TensorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(dict(self.options), True)


@dataclass
class ChunkPart(InputPartition):
    rows: list[tuple[int, str, int, int, int]]

    def __init__(self, rows: list[tuple[int, str, int, int, int]]):
        self.rows = rows


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = parse_roots(options.get("uri_root_map"))
        self.store = json.loads(options["store"]) if "store" in options else None
        self.requests = json.loads(options.get("manifest", "[]"))
        self.limit = int(options.get("partition_bytes", PARTITION_BYTES))
        self.options = reader_options(options, [r[1] for r in self.requests], self.roots)

    def partitions(self) -> list[ChunkPart]:
        parts, now, size = [], [], 0
        for file_id, path, offset, sizes in self.requests:
            at = offset
            for i, n in enumerate(sizes):
                if now and size + n > self.limit:
                    parts.append(ChunkPart(now))
                    now, size = [], 0
                now.append((file_id, path, i, at, n))
                size += n + 64
                at += n
        return parts + [ChunkPart(now)] * bool(now) or [ChunkPart([])]

    def read(self, partition: ChunkPart) -> Iterator[pa.RecordBatch]:
        yield from read_manifest(partition.rows, self.roots, self.store, self.options)


_CHUNK_ARROW = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("chunk_idx", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])


def read_manifest(rows: list[tuple[int, str, int, int, int]], roots: Roots, store: Store = None, options: Options | None = None) -> Iterator[pa.RecordBatch]:
    """Bytes of (file_id, path, chunk_idx, offset, size), each file opened once for a run of its rows."""
    at = 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][1] == rows[at][1]:
            end += 1
        own = rows[at:end]
        for a, b, data in read_rows(own[0][1], [(r[3], r[4]) for r in own], roots, store, options):
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*own[a:b], strict=True), _CHUNK_ARROW, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, data], schema=_CHUNK_ARROW)
        at = end


class ByteChunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bytechunks"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChunkReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the three formats known to a session, with filters on names pushed to the readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TensorCatalog, TensorFile, ByteChunks):
        spark.dataSource.register(source)
    return spark
