"""Scans of tensor files and byte ranges as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.plans import folds
from loomscan.plans.manifest import file_totals
from loomscan.sources.files import remapped, scheme_of
from loomscan.sources.options import Options
from loomscan.sources.tensorfile import CHUNK_SCHEMA, PARTITION_BYTES, read_manifest, register


def _read(spark: SparkSession, kind: str, paths: str | list[str], roots: dict[str, str] | None, store: dict[str, str] | None, options: dict) -> DataFrame:
    reader = register(spark).read.format(kind).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    given = ({"uri_root_map": json.dumps(roots)} if roots else {}) | ({"store": json.dumps(store)} if store else {}) | options
    for k, v in given.items():
        reader = reader.option(k, str(v))
    return reader.load()


def tensor_catalog(spark: SparkSession, paths: str | list[str], roots: dict[str, str] | None = None, store: dict[str, str] | None = None, **options) -> DataFrame:
    """One row for each tensor of the files, from headers alone."""
    return _read(spark, "tensorcatalog", paths, roots, store, options)


def tensors(spark: SparkSession, paths: str | list[str], roots: dict[str, str] | None = None, names: list[str] | None = None, store: dict[str, str] | None = None, **options) -> DataFrame:
    """One row for each tensor, with its bytes. Files that hold a name twice between them give two rows."""
    return _read(spark, "tensorfile", paths, roots, store, options | ({"names": json.dumps(names)} if names is not None else {}))


def check_chunks(manifest: DataFrame) -> DataFrame:
    """manifest with status: 0, or the code of what is wrong with the request of that file as a whole. A request without chunks is a row with null chunk_idx and size."""
    whole = manifest.groupBy("file_id").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__bytes"), F.count("size").alias("__n"), F.min("size").alias("__least"))
    status = F.when((F.col("__bytes") == 0) & (F.col("__n") == 0), 8).when((F.col("__bytes") <= 0) | (F.col("__n") == 0) | (F.col("__least") < 0), 7).otherwise(0)
    return manifest.join(whole, "file_id").withColumn("status", status).drop("__bytes", "__n", "__least")


def _manifest(manifest: DataFrame, *more: str) -> DataFrame:
    """The columns that readers take; ranges that no file can hold are errors."""
    size, offset = F.col("size").cast("bigint"), F.col("offset").cast("bigint")
    wrong = (size < 0) | (offset < 0) | (size > F.lit((1 << 63) - 1) - offset)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("Invalid request parameters: "), F.col("path"), F.lit(": "), size.cast("string"), F.lit(" bytes at "), offset.cast("string"))).cast("bigint")).otherwise(size)
    return manifest.select(F.col("file_id").cast("bigint"), "path", F.col("chunk_idx").cast("int"), offset.alias("offset"), checked.alias("size"), *more)


def _reader(roots: dict[str, str] | None, store: dict[str, str] | None, options: dict):
    given = {k: str(v) for k, v in options.items()}
    found = {kind: Options.read(kind, given=given) for kind in ("file", "object")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "chunk_idx", "offset", "size")), strict=True))
            if rows:
                local = scheme_of(remapped(rows[0][1], roots)) == "file"
                yield from read_manifest(rows, roots or {}, store, found["file" if local else "object"])

    return run


def read_chunks(manifest: DataFrame, roots: dict[str, str] | None = None, partition_bytes: int = PARTITION_BYTES, store: dict[str, str] | None = None, **options) -> DataFrame:
    """The bytes of manifest rows (file_id, path, chunk_idx, offset, size). Rows are dealt by ranges of (file, chunk), so a task reads neighbours with one open; paths must be of one scheme."""
    rows = _manifest(manifest)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct(F.regexp_extract("path", "^([a-z0-9]+)://", 1))).first()
    if total[1] > 1:
        raise ValueError("paths of several kinds of storage in one request")
    parts = max(1, min(-(-int(total[0]) // partition_bytes), 1 << 16))
    return rows.repartitionByRange(parts, "file_id", "chunk_idx").sortWithinPartitions("file_id", "chunk_idx").mapInArrow(_reader(roots, store, options), CHUNK_SCHEMA)


def read_partitioned(manifest: DataFrame, n: int, policy: str | None = None, roots: dict[str, str] | None = None, store: dict[str, str] | None = None, **options) -> DataFrame:
    """The bytes of manifest rows, read by a plan: chunks dealt over n parts by the policy, each part read by one task in order of place, neighbouring ranges in one request.

    Rows have their part. Should a part come back with fewer chunks than it was dealt, reading is an error.
    """
    rows = manifest.select("file_id", "path", "chunk_idx", "offset", "size")
    parts = folds.partition(rows, file_totals(rows), n, policy)
    read = _reader(roots, store, options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = batch.column("part")
            done = 0
            for out in read([batch.drop_columns(["part"])]):
                yield pa.RecordBatch.from_arrays([*out.columns, dealt.slice(done, out.num_rows)], names=[*out.schema.names, "part"])
                done += out.num_rows
            if done != batch.num_rows:
                raise RuntimeError(f"No chunks to read: {batch.num_rows - done} of {batch.num_rows} are missing")

    return _manifest(parts, "part").repartition(n, "part").sortWithinPartitions("part", "path", "offset", "file_id", "chunk_idx").mapInArrow(run, CHUNK_SCHEMA + ", part bigint")


def with_metadata(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks (file_id, chunk_idx, data) with the tensor each of them is: the join a tensor iterator makes. Spark broadcasts the catalog only if it is small."""
    return chunks.select("file_id", F.col("chunk_idx").alias("tensor_idx"), "data").join(catalog, ["file_id", "tensor_idx"])
