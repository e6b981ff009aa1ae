"""Planning steps that depend on all steps before them.

They run over manifests, a row of a few numbers for each chunk and never its bytes. Where each part has a state of its own, parts
are passed side by side. Requests are packed in ranges of rows side by side, too: each range works out where it would end for
every state that it could begin with, those answers are chained in one short pass, and then each range knows its state. The bins
of lightest_bin depend on all rows before: there one ordered pass over sorted rows (Spark spills where it must) keeps the state.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomscan.sources.options import Options
from loomscan.sources.shared import fresh_dir

#: Rows of a manifest that are packed in one pass, and of a range beyond that.
RANGE_ROWS = 1 << 20


def ordered_pass(rows: DataFrame, order: list, inputs: list[str], step: Callable[[], Callable[..., tuple]], outputs: dict[str, str], by: str | None = None) -> DataFrame:
    """rows with new bigint columns: step() makes a function with a state of its own, called with the inputs of each row in order.

    With by, each of its values has a state and an order of its own, and they are passed side by side.
    """
    names = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, at = step(), None
        for batch in batches:
            found = []
            for key, *x in zip(batch.column(by).to_pylist() if by else [None] * batch.num_rows, *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if key != at:
                    apply, at = step(), key
                found.append(apply(*x))
            new = list(zip(*found, strict=True)) or [()] * len(outputs)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=pa.int64()) for c in new)], names=[*names, *outputs])

    dealt = rows.repartition(by).sortWithinPartitions(by, *order) if by else rows.repartition(1).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, kinds + "".join(f", {n} {t}" for n, t in outputs.items()))


def pack_requests(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """Next fit: chunks in order (file, chunk) go to one request until the next would exceed the limit. Adds request_id, request_offset.

    Without a limit that of the settings counts. A limit below the largest chunk is an error. Chunks of no bytes stay in the
    request that is open when they come.
    """
    sums = manifest.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    if limit is None:
        limit = max(Options.read().request_limit(int(sums[0]), int(sums[1])), 1)
    if sums[2] > RANGE_ROWS:
        return _pack_by_ranges(manifest, limit, -(-int(sums[2]) // RANGE_ROWS))

    def step():
        request, used = 0, 0

        def put(size):
            nonlocal request, used
            if size > limit:
                raise ValueError(f"memory limit {limit} is below a chunk of {size} bytes")
            if used + size > limit:
                request, used = request + 1, 0
            used += size
            return request, used - size

        return put

    return ordered_pass(manifest, ["file_id", "chunk_idx"], ["size"], step, {"request_id": "bigint", "request_offset": "bigint"})


def _pack_by_ranges(manifest: DataFrame, limit: int, n: int) -> DataFrame:
    """pack_requests() over n ranges of rows. The ranges are written, so that all steps see the same ones."""
    spark, place = manifest.sparkSession, fresh_dir(manifest.sparkSession, "ranges")
    order = ["file_id", "chunk_idx"]
    manifest.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()).write.parquet(place)
    rows = spark.read.parquet(place)

    def sorted_sizes(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The rows in order, and where each ends and begins among the bytes of the range."""
        table = table.sort_by([(c, "ascending") for c in order])
        sizes = table.column("size").to_numpy()
        if len(sizes) and sizes.max() > limit:
            raise ValueError(f"memory limit {limit} is below a chunk of {sizes.max()} bytes")
        ends = np.cumsum(sizes)
        return table, ends, ends - sizes

    def answers(table: pa.Table) -> pa.Table:
        """If a request begins at a row: how many more begin in the range, and the bytes of the last. For rows that the first can begin at."""
        table, ends, begins = sorted_sizes(table)
        after = np.searchsorted(ends, begins + limit, side="right").tolist()
        more, used = [0] * len(ends), (ends[-1] - begins).tolist()
        for i in range(len(ends) - 1, -1, -1):
            if after[i] < len(ends):
                more[i], used[i] = more[after[i]] + 1, used[after[i]]
        first = int(np.searchsorted(begins, limit, side="right"))
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], type=pa.int32()), "n": pa.array([len(ends)]), "total": pa.array([int(ends[-1])]), "ends": pa.array([ends[:first]], type=pa.list_(pa.int64())), "more": pa.array([more[:first]], type=pa.list_(pa.int64())), "used": pa.array([used[:first]], type=pa.list_(pa.int64()))})

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = held = 0
        for batch in batches:
            states = []
            for r in batch.to_pylist():
                states.append((r["range"], request, held))
                at = bisect.bisect_right(r["ends"], limit - held)
                if at < r["n"]:
                    request, held = request + 1 + r["more"][at], r["used"][at]
                else:
                    held += r["total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*states, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["range", "request_id", "request_offset"])

    def pack(table: pa.Table) -> pa.Table:
        table, ends, begins = sorted_sizes(table)
        request, held = table.column("request_id")[0].as_py(), table.column("request_offset")[0].as_py()
        starts, at = [], int(np.searchsorted(ends, limit - held, side="right"))
        while at < len(ends):
            starts.append(at)
            at = int(np.searchsorted(ends, begins[at] + limit, side="right"))
        later = np.searchsorted(starts, np.arange(len(ends)), side="right")
        base = np.concatenate([[-held], begins[starts]])[later] if starts else np.full(len(ends), -held)
        kept = table.drop_columns(["range", "request_id", "request_offset"])
        return kept.append_column("request_id", pa.array(request + later)).append_column("request_offset", pa.array(begins - base))

    found = rows.groupBy("range").applyInArrow(answers, "range int, n bigint, total bigint, ends array<bigint>, more array<bigint>, used array<bigint>")
    states = found.repartition(1).sortWithinPartitions("range").mapInArrow(chain, "range int, request_id bigint, request_offset bigint")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return rows.join(states, "range").select(*manifest.columns, "range", "request_id", "request_offset").groupBy("range").applyInArrow(pack, kinds + ", request_id bigint, request_offset bigint")


def request_indices(packed: DataFrame) -> DataFrame:
    """Local and global chunk numbers of packed chunks: places in the file within a request, and in the whole file."""
    local = Window.partitionBy("request_id", "file_id").orderBy("chunk_idx")
    whole = Window.partitionBy("file_id").orderBy("request_id", "chunk_idx")
    return packed.select("request_id", "file_id", (F.row_number().over(local) - 1).cast("bigint").alias("local_idx"), (F.row_number().over(whole) - 1).cast("bigint").alias("global_idx"), F.col("chunk_idx").cast("bigint").alias("chunk_idx"))


def lightest_bin(rows: DataFrame, n: int, order: list[str], size: str = "size") -> DataFrame:
    """Longest first, each to the bin with the least load, ties to the lowest bin. Adds part. order breaks ties of size."""
    if n <= 0:
        raise ValueError("the number of partitions must be positive")

    def step():
        bins = [(0, i) for i in range(n)]

        def put(size):
            load, i = bins[0]
            heapq.heapreplace(bins, (load + size, i))
            return (i,)

        return put

    return ordered_pass(rows, [F.desc(size), *order], [size], step, {"part": "bigint"})


def partition_chunks(manifest: DataFrame, n: int) -> DataFrame:
    """Chunks with bytes dealt over n parts. manifest has offset."""
    return lightest_bin(manifest.filter("size > 0"), n, ["file_id", "chunk_idx"])


def partition_files(totals: DataFrame, n: int) -> DataFrame:
    """Whole files (file_id, total_bytes) dealt over n parts."""
    return lightest_bin(totals, n, ["file_id"], "total_bytes")


def partition(manifest: DataFrame, totals: DataFrame, n: int, policy: str | None = None) -> DataFrame:
    """Chunk rows with part, by either policy; without one by that of the settings."""
    policy = Options.read().partition_policy if policy is None else policy
    if policy not in ("chunks", "files"):
        raise ValueError(f"unknown partition policy {policy!r}")
    if policy == "chunks":
        return partition_chunks(manifest, n)
    return manifest.join(partition_files(totals, n).select("file_id", "part"), "file_id")


def coalesce_ranges(parts: DataFrame) -> DataFrame:
    """Chunk rows with run and run_idx: in each part and path, chunks that follow each other without a gap make one run."""
    order = Window.partitionBy("part", "path").orderBy("offset", "file_id", "chunk_idx")
    marked = parts.withColumn("new", F.when(F.lag(F.col("offset") + F.col("size")).over(order) == F.col("offset"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    inside = Window.partitionBy("part", "path", "run").orderBy("offset", "file_id", "chunk_idx")
    return runs.withColumn("run_idx", (F.row_number().over(inside) - 1).cast("bigint"))


def aligned_batches(rows: DataFrame, order: list[str], batch_bytes: int | None = None, max_chunks: int = 256, alignment: int | None = None) -> DataFrame:
    """Each part's chunks, in order, fill batches of at most max_chunks and batch_bytes, each at an aligned place. Adds batch_id, which counts from 0 in each part, and batch_offset.

    A part fills its batches from its own chunks alone, so parts are passed side by side; rows without part are one. Sizes that aren't given are those of
    the settings. A chunk larger than batch_bytes has a batch of its own.
    """
    settings = Options.read()
    batch_bytes = settings.batch_bytes if batch_bytes is None else batch_bytes
    alignment = settings.alignment if alignment is None else alignment
    if not 0 <= alignment <= 1 << 20:
        raise ValueError("alignment must be from 0 to 1 MiB")

    def step():
        batch, used, count = 0, 0, 0

        def put(size):
            nonlocal batch, used, count
            at = used + (-used) % alignment if alignment > 1 else used
            if count and (count >= max_chunks or at + size > batch_bytes):
                batch, used, count, at = batch + 1, 0, 0, 0
            used, count = at + size, count + 1
            return batch, at

        return put

    return ordered_pass(rows, order, ["size"], step, {"batch_id": "bigint", "batch_offset": "bigint"}, by="part" if "part" in rows.columns else None)


def broadcast_schedule(batches: DataFrame, n: int, expected: int | None = None) -> DataFrame:
    """Every chunk of every batch once for each of n ranks that gets it: in round batch_id the parts send their batches one after the other, and each rank receives all of them.

    With expected, the number of chunks there are, batches that hold fewer are an error.
    """
    rows = batches
    if expected is not None:
        held = batches.count()
        if held < expected:
            raise RuntimeError(f"No chunks to read: {expected - held} of {expected} are in no batch")
    turn = Window.partitionBy("part", "batch_id").orderBy("batch_offset", "file_id", "chunk_idx")
    placed = rows.withColumn("turn", (F.row_number().over(turn) - 1).cast("bigint"))
    return placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("rank"))
