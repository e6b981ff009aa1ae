"""Connected components of a link table, by alternating large-star and small-star steps.

Links stay distributed; each round is written to the shared folder, which cuts the lineage and survives lost executors. Least
neighbours are found by an aggregation (combined before the shuffle) and joined back, so that a node with very many links is
a skewed join, which adaptive execution splits, and never one task's group. These joins merge: a round's files are a fraction of
what their rows take in memory, so that their size would have the driver gather and broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a bigint, b bigint) to (node, component): each node that has a link, with the least node it reaches. No links give no rows."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        now = written(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
