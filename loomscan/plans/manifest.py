"""Chunk manifests: tables (file_id, path, file_offset, chunk_idx, size), and what follows from them by sums and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered_files(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows with file_id: the place of the path among all distinct paths. Only the distinct paths are put in one order."""
    files = rows.select(path).distinct()
    ids = files.select(path, (F.row_number().over(Window.orderBy(path)) - 1).cast("bigint").alias("file_id"))
    return rows.join(ids, path)


def chunk_offsets(manifest: DataFrame) -> DataFrame:
    """Where each chunk begins in its file: the file's offset and the sizes before it."""
    before = Window.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.col("file_offset") + F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint")))


def file_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("file_id", "path").agg(F.count("*").alias("n_chunks"), F.sum("size").alias("total_bytes"), F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("largest"))


def buffer_offsets(manifest: DataFrame) -> DataFrame:
    """Where each file begins in a buffer that holds all files one after the other. The window runs over files, not chunks."""
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    return file_totals(manifest).select("file_id", "total_bytes", F.coalesce(F.sum("total_bytes").over(before), F.lit(0).cast("bigint")).alias("buffer_offset"))


def global_offsets(manifest: DataFrame) -> DataFrame:
    """chunk rows with start: the place of the chunk among the bytes of all files."""
    before = Window.partitionBy("file_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    own = manifest.withColumn("in_file", F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint")))
    return own.join(buffer_offsets(manifest).select("file_id", "buffer_offset"), "file_id").withColumn("start", F.col("buffer_offset") + F.col("in_file"))


def memory_modes(manifest: DataFrame, limit: int) -> DataFrame:
    """Bytes of the buffer under each memory mode; a limit below the largest chunk is an error."""
    sums = manifest.agg(F.coalesce(F.sum("size"), F.lit(0).cast("bigint")).alias("total"), F.coalesce(F.max("size"), F.lit(0).cast("bigint")).alias("largest"))
    limited = F.when(F.col("largest") > limit, F.raise_error(F.concat(F.lit(f"memory limit {limit} is below the largest chunk, "), F.col("largest").cast("string"))).cast("bigint")).otherwise(F.least(F.col("total"), F.lit(limit).cast("bigint")))
    modes = F.explode(F.array(F.struct(F.lit("unlimited").alias("mode"), F.col("total").alias("bytes")), F.struct(F.lit("largest_chunk").alias("mode"), F.col("largest").alias("bytes")), F.struct(F.lit("limited").alias("mode"), limited.alias("bytes"))))
    return sums.select(modes.alias("m")).select(F.col("m.mode").alias("mode"), F.col("m.bytes").alias("buffer_bytes"))
