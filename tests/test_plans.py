import heapq
import random

import pytest
from pyspark.sql import functions as F

from loomscan.plans import folds, manifest, workers

SCHEMA = "file_id bigint, path string, file_offset bigint, chunk_idx bigint, size bigint"


def rows_of(spark, files):
    """files: (id, path, offset, sizes)."""
    return spark.createDataFrame([(i, p, o, k, n) for i, p, o, sizes in files for k, n in enumerate(sizes)], SCHEMA)


def packed(spark, files, limit):
    got = {}
    for r in folds.pack_requests(rows_of(spark, files), limit).collect():
        got.setdefault(r["request_id"], {}).setdefault(r["file_id"], []).append((r["chunk_idx"], r["size"]))
    return [{f: [s for _, s in sorted(x)] for f, x in got[k].items()} for k in sorted(got)]


@pytest.mark.parametrize(
    ("files", "limit", "want"),
    [
        ([(17, "a", 10, [1, 2, 3, 4])], 5, [{17: [1, 2]}, {17: [3]}, {17: [4]}]),
        ([(17, "a", 10, [1, 2, 3, 4]), (18, "b", 10, [1, 2, 3, 4])], 7, [{17: [1, 2, 3]}, {17: [4], 18: [1, 2]}, {18: [3, 4]}]),
        ([(17, "a", 0, [0]), (18, "b", 0, [3, 4])], 10, [{17: [0], 18: [3, 4]}]),
        ([(17, "a", 0, [7]), (18, "b", 0, [0, 7])], 7, [{17: [7], 18: [0]}, {18: [7]}]),
    ],
)
def test_packing(spark, files, limit, want):
    assert packed(spark, files, limit) == want


@pytest.mark.parametrize("range_rows", [3, 10, 60])
def test_packing_by_ranges(spark, monkeypatch, range_rows):
    """Ranges of few rows, requests that span several of them, empty chunks: the same requests as in one pass."""
    rng = random.Random(range_rows)
    files = [(i, f"p{i}", 0, [rng.choice([0, 0, 1, rng.randint(1, 40), 40]) for _ in range(rng.randint(1, 40))]) for i in range(12)]
    rows = rows_of(spark, files)
    for limit in (40, 55, 300, 10**6):
        monkeypatch.setattr(folds, "RANGE_ROWS", 10**9)
        want = sorted(map(tuple, folds.pack_requests(rows, limit).collect()))
        monkeypatch.setattr(folds, "RANGE_ROWS", range_rows)
        assert sorted(map(tuple, folds.pack_requests(rows, limit).collect())) == want
    with pytest.raises(Exception, match="memory limit 39"):
        folds.pack_requests(rows, 39).collect()


def test_packing_limit_below_a_chunk(spark):
    with pytest.raises(Exception, match="memory limit 3"):
        folds.pack_requests(rows_of(spark, [(1, "a", 0, [1, 4])]), 3).collect()
    with pytest.raises(Exception, match="memory limit 3"):
        manifest.memory_modes(rows_of(spark, [(1, "a", 0, [1, 4])]), 3).collect()


@pytest.mark.parametrize(("files", "limit", "want"), [([(1, "a", 0, [1, 2, 3, 4])], 5, (10, 4, 5)), ([(1, "a", 0, [1, 2]), (2, "b", 0, [7])], 50, (10, 7, 10)), ([], 9, (0, 0, 0))])
def test_memory_modes(spark, files, limit, want):
    got = {r["mode"]: r["buffer_bytes"] for r in manifest.memory_modes(rows_of(spark, files), limit).collect()}
    assert (got["unlimited"], got["largest_chunk"], got["limited"]) == want


BASE = [(0, "A", 1000, [100, 50, 200]), (1, "B", 0, [400]), (2, "A", 5000, [80, 20]), (3, "C", 800, [300, 150])]


def test_partition_policies(spark):
    rows = manifest.chunk_offsets(rows_of(spark, BASE))
    chunks = folds.partition(rows, manifest.file_totals(rows), 3)
    files = folds.partition(rows, manifest.file_totals(rows), 3, "files")
    sums = lambda df: sorted(r[1] for r in df.groupBy("part").agg(F.sum("size")).collect())
    assert sums(chunks) == [420, 430, 450] and sums(files) == [400, 450, 450]
    for n in (0, -1):
        with pytest.raises(ValueError):
            folds.partition_chunks(rows, n)
    with pytest.raises(ValueError):
        folds.partition(rows, rows, 2, "other")


def test_ranges_coalesce(spark):
    rows = manifest.chunk_offsets(rows_of(spark, [(0, "A", 0, [10, 20]), (1, "A", 30, [5])]))
    got = folds.coalesce_ranges(folds.partition_chunks(rows, 1)).orderBy("offset").collect()
    assert [(r["run"], r["run_idx"], r["size"]) for r in got] == [(1, 0, 10), (1, 1, 20), (1, 2, 5)]


def test_empty_chunks_are_dropped(spark):
    rows = manifest.chunk_offsets(rows_of(spark, [(0, "Z", 0, [10, 50, 0, 100]), (1, "Y", 10, [0, 0, 25])]))
    assert folds.partition_chunks(rows, 2).agg(F.sum("size"), F.min("size")).first()[:] == (185, 10)


def test_lightest_bin(spark):
    rng = random.Random(1)
    files = [(i, f"p{i}", 0, [rng.randint(1, 50) for _ in range(20)]) for i in range(10)]
    got = {(r["file_id"], r["chunk_idx"]): r["part"] for r in folds.partition_chunks(manifest.chunk_offsets(rows_of(spark, files)), 4).collect()}
    bins = [(0, i) for i in range(4)]
    for size, f, k in sorted(((n, f, k) for f, _, _, sizes in files for k, n in enumerate(sizes)), key=lambda x: (-x[0], x[1], x[2])):
        load, i = heapq.heappop(bins)
        assert got[f, k] == i
        heapq.heappush(bins, (load + size, i))


def walk(files, block, concurrency):
    """Tasks (file, chunk, worker, bytes) by walking through the workers' quotas byte range by byte range."""
    total = sum(sum(sizes) for _, _, _, sizes in files)
    n = max(min(total // block, concurrency), 1)
    base = total // block // n * block
    left = [total - base * (n - 1)] + [base] * (n - 1)
    w, out = 0, []
    for f, _, _, sizes in files:
        for k, size in enumerate(sizes):
            if size == 0:
                out.append((f, k, w, 0))
            while size:
                while left[w] == 0:
                    w += 1
                take = min(size, left[w])
                out.append((f, k, w, take))
                left[w] -= take
                size -= take
    return sorted(out)


def test_workers_walk_the_bytes(spark):
    rng = random.Random(2)
    for trial in range(6):
        files = [(i, f"p{i}", 0, [rng.choice([0, 1, rng.randint(1, 90)]) for _ in range(rng.randint(1, 8))]) for i in range(rng.randint(1, 9))]
        if trial == 0:
            files = [(0, "p", 0, [0, 0])]
        rows = manifest.global_offsets(rows_of(spark, files)).select("file_id", "chunk_idx", "size", "start")
        quota = workers.quotas(rows.agg(F.sum("size").alias("total")), 16, 5)
        got = [(r["file_id"], r["chunk_idx"], r["worker"], r["task_size"]) for r in workers.assign(rows, quota).collect()]
        assert sorted(got) == walk(files, 16, 5)


def test_aligned_batches(spark):
    rng = random.Random(3)
    files = [(i, f"p{i}", 0, [rng.randint(1, 5120) for _ in range(4)]) for i in range(20)]
    got = folds.aligned_batches(rows_of(spark, files), ["file_id", "chunk_idx"], 10240, 5, 512).collect()
    ends = {}
    for r in sorted(got, key=lambda r: (r["file_id"], r["chunk_idx"])):
        assert r["batch_offset"] % 512 == 0 and r["batch_offset"] >= ends.get(r["batch_id"], (0, 0))[0]
        ends[r["batch_id"]] = (r["batch_offset"] + r["size"], ends.get(r["batch_id"], (0, 0))[1] + 1)
    assert all(end <= 10240 and n <= 5 for end, n in ends.values())
    for bad in (-1, (1 << 20) + 1):
        with pytest.raises(ValueError):
            folds.aligned_batches(rows_of(spark, files), ["file_id"], 1, 1, bad)


def test_parts_and_blocks(spark):
    rows = rows_of(spark, [(0, "a", 0, [0, 5, 10, 25])])
    parts = sorted((r["chunk_idx"], r["part_idx"], r["part_offset"], r["part_size"]) for r in workers.object_parts(rows, 10).collect())
    assert parts == [(0, 0, 0, 0), (1, 0, 0, 5), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 15)]
    blocks = sorted((r["chunk_idx"], r["block_offset"], r["block_size"]) for r in workers.block_reads(rows, 10).collect())
    assert blocks == [(1, 0, 5), (2, 0, 10), (3, 0, 10), (3, 10, 10), (3, 20, 5)]
