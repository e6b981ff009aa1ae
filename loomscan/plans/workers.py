"""Byte-balanced assignment of files to workers, in closed form.

All files lie one after the other in one space of bytes. Worker 0 owns its first base + rest bytes, every other worker the
next base bytes, whatever the borders of files. Which workers a range meets follows by division, so ranges are exploded over
their workers and no interval is ever joined with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomscan.functions.sizes import div, worker_base, worker_count
from loomscan.sources.options import SCOPES, Options


def quotas(total: DataFrame, block: int, concurrency: int) -> DataFrame:
    """One row from one row (total): workers, base and rest."""
    t, b = F.col("total"), F.lit(block).cast("bigint")
    counted = total.select(t, worker_count(t, b, concurrency).alias("workers"))
    based = counted.select("total", "workers", worker_base(t, b, F.col("workers")).alias("base"))
    return based.select("*", (F.col("total") - F.col("base") * F.col("workers")).alias("rest"))


def worker_ranges(quota: DataFrame) -> DataFrame:
    """(worker, range_start, range_end, n_bytes) of each worker."""
    rows = quota.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("workers") - 1)).alias("worker"))
    start = F.when(F.col("worker") == 0, F.lit(0).cast("bigint")).otherwise(F.col("base") * F.col("worker") + F.col("rest"))
    end = F.col("base") * (F.col("worker") + 1) + F.col("rest")
    return rows.select("worker", start.alias("range_start"), end.alias("range_end"), (end - start).alias("n_bytes"))


def _owner(byte: Column) -> Column:
    """The worker that owns a byte."""
    return F.when((F.col("base") == 0) | (byte < F.col("base") + F.col("rest")), F.lit(0).cast("bigint")).otherwise(div(byte - F.col("rest"), F.greatest(F.col("base"), F.lit(1).cast("bigint"))))


def assign(ranges: DataFrame, quota: DataFrame) -> DataFrame:
    """Ranges (start, size, ...) cut at the workers' borders: worker, task_start, task_size. A range without bytes stays with the worker of the byte before it."""
    rows = ranges.crossJoin(F.broadcast(quota.limit(1)))  # quota is one row
    end = F.col("start") + F.col("size")
    first = F.when(F.col("size") > 0, _owner(F.col("start"))).otherwise(_owner(F.greatest(F.col("start") - 1, F.lit(0).cast("bigint"))))
    last = F.when(F.col("size") > 0, _owner(end - 1)).otherwise(first)
    met = rows.select("*", F.explode(F.sequence(first, last)).alias("worker"))
    low = F.when(F.col("worker") == 0, F.lit(0).cast("bigint")).otherwise(F.col("base") * F.col("worker") + F.col("rest"))
    high = F.col("base") * (F.col("worker") + 1) + F.col("rest")
    cut = met.select("*", F.when(F.col("size") > 0, F.greatest("start", low)).otherwise(F.col("start")).alias("task_start"), F.when(F.col("size") > 0, F.least(end, high)).otherwise(F.col("start")).alias("__end"))
    return cut.select(*ranges.columns, "worker", "task_start", (F.col("__end") - F.col("task_start")).alias("task_size"))


def rank_groups(ranks: DataFrame, scope: str | None = None) -> DataFrame:
    """ranks (rank, host) with group_id, place in the group and group_size: ranks of a host make a group (local), or all do (global); without a scope that of the settings counts."""
    scope = Options.read().scope if scope is None else scope
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    hosts = ranks.groupBy("host").agg(F.count("*").alias("group_size"))  # few: the windows below run over hosts and ranks, never chunks
    if scope == "local":
        numbered = hosts.withColumn("group_id", (F.row_number().over(Window.orderBy("host")) - 1).cast("bigint"))
        rows, by = ranks.join(numbered, "host"), Window.partitionBy("host").orderBy("rank")
    else:
        total = hosts.agg(F.sum("group_size").alias("group_size"))
        rows, by = ranks.crossJoin(F.broadcast(total)).withColumn("group_id", F.lit(0).cast("bigint")), Window.orderBy("rank")
    return rows.withColumn("place", (F.row_number().over(by) - 1).cast("bigint"))


def completion(tasks: DataFrame, status: Column, order: list | None = None) -> DataFrame:
    """A chunk is complete when all its tasks are; its status is that of the last of them that failed, by order (by worker, then place), else 0."""
    by = F.struct(*(order or ["worker", "task_start"]))
    failed = F.when(status != 0, F.struct(by.alias("at"), status.cast("int").alias("status")))
    return tasks.groupBy("file_id", "chunk_idx").agg(F.count("*").alias("n_tasks"), F.sum("task_size").alias("n_bytes"), F.coalesce(F.max(failed)["status"], F.lit(0)).alias("status"))


def batch_ranges(tasks: DataFrame) -> DataFrame:
    """For each worker and file the range that its tasks cover."""
    return tasks.groupBy("worker", "file_id").agg(F.count("*").alias("n_tasks"), F.min("task_start").alias("range_start"), F.max(F.col("task_start") + F.col("task_size")).alias("range_end"))


def object_parts(rows: DataFrame, chunk: int) -> DataFrame:
    """Parts of ranged requests: as many whole chunks as there are (one at least), the last with all that is left."""
    n = F.greatest(div(F.col("size"), chunk), F.lit(1).cast("bigint"))
    parts = rows.select("*", n.alias("n_parts"), F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("part_idx"))
    return parts.select(*rows.columns, "part_idx", (F.col("part_idx") * chunk).alias("part_offset"), F.when(F.col("part_idx") == F.col("n_parts") - 1, F.col("size") - F.col("part_idx") * chunk).otherwise(F.lit(chunk).cast("bigint")).alias("part_size"))


def block_reads(rows: DataFrame, block: int) -> DataFrame:
    """Blocks in which a file system range is read: full ones, then what is left. A range without bytes has none."""
    n = div(F.col("size") + (block - 1), block)
    parts = rows.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("block_idx"))
    return parts.select(*rows.columns, "block_idx", (F.col("block_idx") * block).alias("block_offset"), F.least(F.lit(block).cast("bigint"), F.col("size") - F.col("block_idx") * block).alias("block_size"))


def completion_block(tasks: DataFrame, block: int) -> DataFrame:
    """With which block of its worker's range in the file each task is complete."""
    first = batch_ranges(tasks).select("worker", "file_id", "range_start")
    return tasks.join(first, ["worker", "file_id"]).withColumn("done_block", div(F.col("task_start") + F.col("task_size") - F.col("range_start") + (block - 1), block))
