"""Checks of tensor catalogs as column expressions, for catalogs that come from tables instead of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.dtypes import DTYPES
from loomscan.functions.sizes import element_count


def widths(spark) -> DataFrame:
    return spark.createDataFrame([(x.name, x.width) for x in DTYPES.values()], "dtype string, width int")


def overlap_gap(catalog: DataFrame) -> DataFrame:
    """Each tensor (file, name, start, end) with what its start makes of the one before: ok, overlap or gap."""
    order = Window.partitionBy("file").orderBy("start", "end", "name")
    before = F.coalesce(F.lag("end").over(order), F.lit(0).cast("bigint"))
    return catalog.select("file", "name", F.when(F.col("start") < before, "overlap").when(F.col("start") > before, "gap").otherwise("ok").alias("verdict"))


def shapes(catalog: DataFrame) -> DataFrame:
    """Each tensor with the bytes that shape and type claim and those that its offsets reserve. The table of types is a few rows."""
    known = catalog.join(F.broadcast(widths(catalog.sparkSession)), "dtype")
    claimed = element_count(F.col("shape")) * F.col("width")
    return known.select("file", "name", claimed.alias("claimed"), (F.col("end") - F.col("start")).alias("reserved"), F.when(F.col("start") > F.col("end"), "corrupt offset").when(claimed != F.col("end") - F.col("start"), "mismatch").otherwise("ok").alias("verdict"))


def unknown_types(catalog: DataFrame) -> DataFrame:
    """Tensors whose element type isn't known."""
    return catalog.join(F.broadcast(widths(catalog.sparkSession)), "dtype", "left_anti").select("file", "name", "dtype")
