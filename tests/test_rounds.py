"""Memory-capped rounds, planned scans and schedules."""

import random

import pytest
from test_plans import BASE, rows_of

from loomscan.operators import scan
from loomscan.operators.iterate import ChunkStreamer, FileChunks
from loomscan.plans import folds, manifest


def requests(tmp_path, seed, n_files):
    rng, found, want = random.Random(seed), [], {}
    for i in range(n_files):
        sizes = [rng.choice([0, rng.randint(1, 200)]) for _ in range(rng.randint(1, 30))]
        data = rng.randbytes(sum(sizes) + 3)
        (tmp_path / f"f{i}").write_bytes(data)
        found.append(FileChunks(100 + i, str(tmp_path / f"f{i}"), 3, sizes))
        at = 3
        for k, n in enumerate(sizes):
            want[100 + i, k] = data[at : at + n]
            at += n
    return found, want


def test_rounds_hold_no_more_than_the_limit(spark, tmp_path):
    found, want = requests(tmp_path, 1, 5)
    total, largest = sum(r.total_size() for r in found), max(r.max_chunk_size() for r in found)
    for limit in (-1, 0, largest, 3 * largest, 10 * total):
        with ChunkStreamer(spark, memory_limit=limit) as s:
            s.stream_files(found)
            bytes_of = [rows.selectExpr("sum(size)").first()[0] for rows in s.rounds()]
            got = {(i, k): d for i, k, d in s.get_chunks()}
        assert got == want
        cap = {-1: total, 0: largest}.get(limit, min(limit, total))
        assert max(bytes_of) <= cap and sum(bytes_of) == total and (len(bytes_of) > 1) == (cap < total)
    with pytest.raises(ValueError, match="below the largest chunk"), ChunkStreamer(spark, memory_limit=largest - 1) as s:
        s.stream_files(found)


def test_the_limit_comes_from_the_environment(spark, tmp_path, monkeypatch):
    found, want = requests(tmp_path, 2, 3)
    monkeypatch.setenv("LOOMSCAN_MEMORY_LIMIT", "0")
    with ChunkStreamer(spark) as s:
        s.stream_files(found)
        assert s.n_rounds > 1 and {(i, k): d for i, k, d in s.get_chunks()} == want


def rows_for(spark, found):
    return manifest.chunk_offsets(rows_of(spark, [(r.id, r.path, r.offset, r.chunks) for r in found]))


@pytest.mark.parametrize("policy", ["chunks", "files"])
def test_planned_scans_read_every_chunk_once(spark, tmp_path, policy):
    found, want = requests(tmp_path, 3, 6)
    rows = scan.read_partitioned(rows_for(spark, found), 4, policy).collect()
    kept = want if policy == "files" else {k: v for k, v in want.items() if v}
    assert {(r["file_id"], r["chunk_idx"]): bytes(r["data"]) for r in rows} == kept and len(rows) == len(kept)
    if policy == "files":
        assert all(len({r["part"] for r in rows if r["file_id"] == f.id}) == 1 for f in found)


def test_policies_come_from_the_environment(spark, monkeypatch):
    rows = manifest.chunk_offsets(rows_of(spark, BASE))
    sums = lambda: sorted(r[1] for r in folds.partition(rows, manifest.file_totals(rows), 3).groupBy("part").agg({"size": "sum"}).collect())
    assert sums() == [420, 430, 450]
    monkeypatch.setenv("LOOMSCAN_PARTITION_POLICY", "files")
    assert sums() == [400, 450, 450]
    monkeypatch.setenv("LOOMSCAN_BATCH_BYTES", "100")
    monkeypatch.setenv("LOOMSCAN_ALIGNMENT", "64")
    got = folds.aligned_batches(rows_of(spark, [(0, "a", 0, [30, 30, 30, 30])]), ["chunk_idx"]).collect()
    assert [(r["batch_id"], r["batch_offset"]) for r in sorted(got, key=lambda r: r["chunk_idx"])] == [(0, 0), (0, 64), (1, 0), (1, 64)]


def test_wrong_ranges_are_errors(spark):
    for size, offset in ((-1, 0), (1, -1), (1 << 62, 1 << 62)):
        rows = spark.createDataFrame([(0, "/x", 0, offset, size)], "file_id bigint, path string, chunk_idx int, offset bigint, size bigint")
        with pytest.raises(Exception, match="Invalid request parameters"):
            scan.read_chunks(rows, partition_bytes=10).collect()


def test_each_part_fills_its_own_batches(spark):
    """Goldens by hand: two parts, batches of at most 3 chunks and 1,000 bytes at multiples of 100."""
    rows = spark.createDataFrame([(p, 0, k, n) for p, sizes in ((0, [250, 300, 500, 20, 20, 20, 20]), (1, [900, 50, 2000, 1])) for k, n in enumerate(sizes)], "part bigint, file_id bigint, chunk_idx bigint, size bigint")
    batches = folds.aligned_batches(rows, ["file_id", "chunk_idx"], 1000, 3, 100)
    got = [(r["part"], r["chunk_idx"], r["batch_id"], r["batch_offset"]) for r in batches.orderBy("part", "chunk_idx").collect()]
    assert got == [(0, 0, 0, 0), (0, 1, 0, 300), (0, 2, 1, 0), (0, 3, 1, 500), (0, 4, 1, 600), (0, 5, 2, 0), (0, 6, 2, 100), (1, 0, 0, 0), (1, 1, 0, 900), (1, 2, 1, 0), (1, 3, 2, 0)]
    schedule = folds.broadcast_schedule(batches, 3, 11).collect()
    assert len(schedule) == 33 and {r["rank"] for r in schedule} == {0, 1, 2}
    assert [r["turn"] for r in sorted(schedule, key=lambda r: r["chunk_idx"]) if (r["part"], r["batch_id"], r["rank"]) == (0, 1, 2)] == [0, 1, 2]
    with pytest.raises(RuntimeError, match="No chunks to read: 1 of 12"):
        folds.broadcast_schedule(batches, 3, 12)
