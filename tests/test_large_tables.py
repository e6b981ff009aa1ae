"""What only large tables or large keys show."""

from oracle import same
from test_functions import human

from loomscan import queries


def test_sizes_beyond_a_long(spark, tmp_path):
    """Products of more than 63 bits were an overflow error; the others are as before."""
    keys = [(1, 1), (149_999, 19_999), (3_000_000_000, 1), (9_000_000, 1_200_000), (9_000_000, -1_200_000), (5_000_000_000, 40), (None, 3), (0, 7)]
    spark.createDataFrame([(a, 1, b) for a, b in keys], "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    text = lambda n: f"{n}.00 B" if n < 0 else human(n)
    got = queries.human_size(spark, str(tmp_path)).collect()
    want = {(a, b): None if a is None else text(a * a * b) for a, b in keys}
    assert sorted(map(str, (r["readable"] for r in got))) == sorted(map(str, want.values()))
    assert "97.20 EB" in want.values()


def test_projection_holds_no_whole_file(spark, small_dir, monkeypatch):
    """A row held its whole file, once for each chunk, and the files' bytes could be broadcast by the driver."""
    monkeypatch.setattr(queries, "BUFFER_BYTES", 1000, raising=False)
    read, asked = queries.scan.read_chunks, []
    monkeypatch.setattr(queries.scan, "read_chunks", lambda rows, *a, **k: (asked.append(rows), read(rows, *a, **k))[1])
    found = queries.chunk_projection(spark, small_dir)
    assert same(found, queries.ORACLE_SQL["chunk_projection"], small_dir) > 0
    largest = queries.largest_chunk(spark, small_dir).first()[0]
    assert max(r["size"] for r in asked[0].collect()) < 1000 + largest
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
