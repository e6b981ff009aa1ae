import numpy as np

from loomscan.llm import neighbours


def exact(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = collected(neighbours.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")))
    want = exact(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.98
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q].get(i, s)) < 1e-12 for q, v in got.items() for i, s in v)


def test_blocks_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    whole = collected(neighbours.nearest(df, bound=6.0))
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 10)
    assert collected(neighbours.nearest(df, bound=6.0)) == whole
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(rows)
    assert {q: [i for i, _ in v] for q, v in whole.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def block_of(x, centre, seed=3):
    turn = neighbours.rotation(x.shape[1], seed)
    return neighbours.Candidates(np.arange(len(x)), x, *neighbours.codes(x - centre, turn), centre), turn


def test_estimates_stay_within_bounds():
    rng = np.random.default_rng(4)
    for dim in (3, 64, 100):
        x = rng.normal(size=(2000, dim)) + 0.3
        held, turn = block_of(x, x.mean(axis=0))
        assert np.allclose(turn @ turn.T, np.eye(dim))
        inside = []
        for q in x[:20]:
            estimate, error = held.estimates(q, q @ turn, 3.0)
            inside.append(np.abs(estimate - x @ q) <= error)
        assert np.mean(inside) > 0.99
        assert np.abs(np.mean([held.estimates(q, q @ turn, 3.0)[0] - x @ q for q in x[:200]])) < 0.02 * dim**0.5


def test_bounds_prune():
    """Of unit vectors without any structure, few are reranked."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(neighbours.CANDIDATE_BLOCK, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    held, turn = block_of(x, x.mean(axis=0))
    looked = [len(held.search(x[i], x[i] @ turn, i, -np.inf, 20, 3.0)[0]) for i in range(200)]
    assert np.mean(looked) < 0.1 * len(x)


def test_hot_vectors_and_cells(spark, monkeypatch):
    """A third of all rows share one vector, and cells are small: neighbours are those of brute force, ties by id."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=6)).astype("<f4").tolist()) for i in range(1200)]
    rows = [(i, [1.0, 2.0, 0.0, -1.0, 0.5, 3.0] if i % 3 == 0 else v) for i, v in rows]
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 8)
    monkeypatch.setattr(neighbours, "TARGET", 1.0)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got, want = collected(neighbours.nearest(df, bound=6.0)), exact(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    assert got[0] == [(i, s) for i, s in want[0]] or all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[0], want[0], strict=True))


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [1.0, None], 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (None, [1.0, 1.0], 1), (9, [-1.0, 2.0], 1), (9, [-1.0, 2.0], 1), (20, [3.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int")
    got = collected(neighbours.nearest(df))
    assert got == {0: [(20, 3.0), (1, 1.0), (2, 1.0), (9, -1.0)], 20: [(0, 3.0), (1, 3.0), (2, 3.0), (9, -3.0)]}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 1")).count() == 0
