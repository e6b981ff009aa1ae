"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.sources.shared import fresh_dir

#: ASCII white space: the characters that part words everywhere in this subpackage.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t-\\r]+"
#: Bounds of what a worker turns into Python objects at a time: rows, and bytes of them as Arrow holds them.
LOT_ROWS = 1000
LOT_BYTES = 8 << 20
#: What stands for a null id: it comes before all others.
NULL_KEY = -(1 << 63)


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in smaller ones (views, not copies), so that a batch of long texts fits a Python worker."""
    for batch in batches:
        rows = max(1, min(LOT_ROWS, batch.num_rows * LOT_BYTES // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder and read them back."""
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is done: it does so when the driver's JVM collects, which large tables may fill disks before."""
    spark.sparkContext._jvm.System.gc()


def own_prefix(df: DataFrame) -> str:
    """What no column of a table begins with: names made of it can't clash."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(key, row): the id as a long, null as the least one, and a hash of the text. Rows that agree in both have equal texts."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_KEY)).alias("key"), F.xxhash64(text_col, F.octet_length(text_col)).alias("row")


def words(text: Column) -> Column:
    """The words of a text, unchanged: maximal runs of characters that aren't ASCII white space. Null has none."""
    return F.coalesce(F.array_remove(F.split(text, SPACE_RE), ""), F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
