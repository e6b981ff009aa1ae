import hashlib
import random

import numpy as np
from oracle import same

from loomscan.llm import substring_dedup
from loomscan.llm.substring_dedup import repeats, super_kmers


def slow(rows, k):
    """(id, words, removed, kept words) of (id, text) rows by comparing all windows."""
    first = {}
    split = [(i, (t or "").replace("\n", " ").split(" ") if t else []) for i, t in rows]
    split = [(i, [w for w in ws if w]) for i, ws in split]
    key = lambda i: -(1 << 63) if i is None else i
    for i, ws in split:
        for s in range(len(ws) - k + 1):
            w = tuple(ws[s : s + k])
            first[w] = min(first.get(w, (key(i), s)), (key(i), s))
    out = []
    for i, ws in split:
        drop = set()
        for s in range(len(ws) - k + 1):
            if first[tuple(ws[s : s + k])] < (key(i), s):
                drop |= set(range(s, s + k))
        out.append((i, len(ws), len(drop), " ".join(w for j, w in enumerate(ws) if j not in drop)))
    return out


def corpus(seed, n, words, vocabulary):
    rng = random.Random(seed)
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 30))] for _ in range(8)]
    rows = []
    for i in range(n):
        ws = []
        while len(ws) < rng.randint(0, words):
            ws += rng.choice(passages) if rng.random() < 0.3 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        rows.append((rng.randint(0, 10 * n), rng.choice([" ", "\n", "  "]).join(ws)))
    return list({i: (i, t) for i, t in rows}.values())


def test_against_brute_force(spark):
    for seed, vocabulary in ((1, [f"w{i}" for i in range(300)]), (2, ["a", "b"]), (3, ["é", "x", "y" * 50])):
        rows = corpus(seed, 80, 60, vocabulary)
        rows += [(10**6, rows[0][1]), (10**6 + 1, rows[3][1] + " " + rows[5][1]), (-5, None), (-4, "")]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        got = substring_dedup.remove_repeats(df, k=6, m=2).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join(r["kept_text"].split())) for r in got) == sorted(slow(rows, 6))


def test_query_against_sql(spark, sf_dir):
    from loomscan.llm.queries import ORACLE_SQL, op4_substring_dedup

    assert same(op4_substring_dedup(spark, sf_dir), ORACLE_SQL["op4_substring_dedup"], sf_dir) == 1000


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (2, text, 1), (2, text, 1), (3, "same " * 30000, 1), (4, "", 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.md5(" ".join(r["kept_text"].split()).encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect()), key=str)
    empty = hashlib.md5(b"").hexdigest()
    whole = hashlib.md5(text.encode()).hexdigest()
    assert [x[:3] for x in got] == [(2, 30, 30), (2, 30, 30), (3, 30000, 29999), (4, 0, 0), (5, 0, 0), (None, 30, 0)]
    assert got[0][3] == got[3][3] == empty and got[5][3] == whole
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_removed_words_leave_the_rest_as_it_was():
    drop = np.zeros(6, dtype=bool)
    drop[2:4] = True
    assert substring_dedup.without(b" a  b\nc d\te f ", drop) == b"a  b\ne f"[:4] + b"\n" + b"e f"


def test_super_kmers_hold_every_window_once():
    hashes = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    first, count, least = super_kmers(hashes, 20, 4)
    assert first[0] == 0 and (np.cumsum(count)[:-1] == first[1:]).all() and count.sum() == 481
    assert len(first) == len(least)


def test_hash_collisions_are_told_apart(monkeypatch):
    contents = [b"a b c", b"a b d", b"x a b c"]
    want = repeats(contents, np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([0, 0, 0]), 3).to_pylist()
    monkeypatch.setattr(substring_dedup, "_mixed", lambda x: np.zeros_like(x))
    assert repeats(contents, np.array([1, 2, 3]), np.array([7, 8, 9]), np.array([0, 0, 0]), 3).to_pylist() == want == [{"key": 3, "row": 9, "s": 1, "e": 4}]


def test_rows_that_share_an_id_keep_their_own_words(spark, tmp_path):
    """Another text under the same id: what is removed of one row doesn't touch the other. Held against the query's SQL."""
    from loomscan.llm.queries import ORACLE_SQL, op4_substring_dedup

    passage = [f"p{i}" for i in range(25)]
    rows = [(1, " ".join(passage + ["x"] + passage)), (1, " ".join(f"u{i}" for i in range(25))), (1, " ".join(passage + ["x"] + passage)), (1, " ".join(["y"] + passage))]
    rows += [(2, " ".join(passage)), (2, " ".join(f"v{i}" for i in range(30))), (2, " ".join(["z", "z"] + [f"v{i}" for i in range(30)])), (0, " ".join(f"v{i}" for i in range(28)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert same(op4_substring_dedup(spark, str(tmp_path)), ORACLE_SQL["op4_substring_dedup"], views={"documents": str(tmp_path / "documents.parquet")}) == len(rows)
    kept = {(r["doc_id"], r["text"]): r["n_removed"] for r in substring_dedup.remove_repeats(df).collect()}
    assert kept[rows[1]] == 0 and kept[rows[4]] == 25


def test_windows_of_hot_minimisers_travel_alone(spark, monkeypatch):
    """Every minimiser hot: the same rows as with none."""
    rows = corpus(5, 60, 80, [f"w{i}" for i in range(40)])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {}
    for name, sample, least in (("none", 1, 1 << 60), ("all", 1, 0)):
        monkeypatch.setattr(substring_dedup, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0.0)
        hot = substring_dedup.hot_minimisers(df.selectExpr("doc_id AS key", "0L AS row", "text"), 6, 2)
        assert (len(hot) > 30) == (name == "all")
        found[name] = sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, k=6, m=2).collect())
    assert found["none"] == found["all"] and [x[1] for x in found["all"]] == [x[2] for x in sorted(slow(rows, 6))]
