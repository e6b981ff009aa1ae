"""Tensor files as a stream: each new file in a folder is catalogued once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.sources.files import parse_roots
from loomscan.sources.headers import read_header
from loomscan.sources.tensorfile import _ARROW, CATALOG_SCHEMA


def _paths(listed: DataFrame, roots: dict[str, str] | None, store: dict[str, str] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_ARROW)
        for batch in batches:
            rows = [(p, None, t.index, t.name, t.dtype, list(t.shape), t.start, t.end, t.base) for p in batch.column(0).to_pylist() for t in read_header(p, roots, store)]
            cols = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return listed.mapInArrow(run, CATALOG_SCHEMA).drop("file_id")


def watch_catalog(spark: SparkSession, folder: str, uri_root_map: str | None = None, glob: str = "*.safetensors", store: dict[str, str] | None = None) -> DataFrame:
    """A streaming catalog of the tensor files that appear in a folder. Only paths of files go through Spark; executors read the headers."""
    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(folder).select("path")
    return _paths(listed, parse_roots(uri_root_map), store)


def arrivals(catalog: DataFrame) -> DataFrame:
    """Tensors and bytes of each file of a batch."""
    return catalog.groupBy("path").agg(F.count("*").alias("n_tensors"), F.sum(F.col("end") - F.col("start")).alias("n_bytes"))
