import zlib

import numpy as np

from loomscan.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in qc.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    test = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels.collect() if r["quality"] is not None and got[r["doc_id"]]["held_out"]]
    good, bad = np.array([s for s, q in test if q]), np.array([s for s, q in test if not q])
    assert len(good) > 300 and len(bad) > 50
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert auc > 0.97, auc
    assert ((good >= 0.3).sum() + (bad < 0.3).sum()) / len(test) > 0.95


def slow_counts(text):
    """(count, of, kind) of each share of a text, and its words, letters in words and lines, character by character."""
    data = (text or "").encode()
    words, word = [], b""
    for i in range(len(data) + 1):
        c = data[i : i + 1]
        if c and c not in b" \t\n\x0b\f\r":
            word += c
        elif word:
            words.append(word)
            word = b""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\f\r")]
    of = lambda chars: (sum(1 for c in data if c in chars), len(data), qc.USUAL_CHARS)
    n, u = len(words), qc.USUAL_WORDS
    shares = {"upper": of(range(65, 91)), "digits": of(range(48, 58)), "symbols": of(b"#*$%&|<>=~^_\\{}[]@"), "shouts": of(b"!?"), "marks": of(b".,;:"), "quotes": of(b"\"'()-/+`"), "wide": of(range(128, 256))}
    shares |= {"distinct": (len(set(words)), n, u), "top_word": (max(map(words.count, set(words)), default=0), n, u), "short_words": (sum(1 for w in words if len(w) < 4), n, u), "ended_words": (sum(1 for w in words if w[-1:] in (b".", b"!", b"?")), n, u), "distinct_lines": (len(set(lines)), len(lines), qc.USUAL_LINES)}
    return shares, n, sum(map(len, words)), len(lines)


def slow_statistics(text):
    shares, n, letters, lines = slow_counts(text)
    out = {"words": np.log(1 + n), "word_length": np.log(1 + (letters + 5 * qc.USUAL_WORDS) / (n + qc.USUAL_WORDS)), "line_words": np.log(1 + n / (lines + 1))}
    out |= {k: np.log((c + qc.USUAL[k] * more) / (of + more) + 0.003) for k, (c, of, more) in shares.items()}
    return [out[k] for k in qc.NAMES]


def test_query_against_brute_force(spark, sf_dir):
    """Every score of the query from counts, means, covariances and densities worked out the plain way."""
    from loomscan.llm.queries import op3_quality_classifier

    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = np.array([slow_statistics(t) for _, t in texts])
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in texts])
    y = np.array([-1 if (q := labels.get(i)) is None else q for i, _ in texts])
    train = ~out & (y >= 0)
    z = (x - x[train].mean(axis=0)) / x[train].std(axis=0)
    odds = []
    for c in (0, 1):
        own = z[train & (y == c)]
        cov = np.cov(own.T, bias=True)
        cov = (1 - qc.SHRINKAGE) * cov + qc.SHRINKAGE * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = z - own.mean(axis=0)
        odds.append(-0.5 * (d @ np.linalg.inv(cov) * d).sum(axis=1) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own)))
    want = {i: (bool(o), 1 / (1 + np.exp(-np.clip(s, -700, 700)))) for (i, _), o, s in zip(texts, out, (odds[1] - odds[0]) / qc.TEMPERATURE, strict=True)}
    got = op3_quality_classifier(spark, sf_dir).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["held_out"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-6
        assert r["predicted"] == (r["score"] >= 0.3)


def test_usual_shares_are_medians_of_training_rows(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()}
    rows = [texts[r["doc_id"]] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    found = [shares for shares, n, _, _ in map(slow_counts, rows[:1500]) if n >= 50]
    for k, v in qc.USUAL.items():
        assert abs(np.median([s[k][0] / s[k][1] for s in found]) - v) < 0.02, k


def test_density_is_that_of_a_shrunken_gaussian():
    rng = np.random.default_rng(2)
    x = {0: rng.normal(1, 2, (300, 3)), 1: rng.normal(-1, 1, (500, 3))}
    model = qc.Discriminant({c: (float(len(v)), v.sum(axis=0), v.T @ v) for c, v in x.items()}, shrinkage=0.2, temperature=1.0)
    both = np.concatenate([x[0], x[1]])
    z = {c: (v - both.mean(axis=0)) / both.std(axis=0) for c, v in x.items()}
    point = (np.array([[0.3, -0.2, 1.0]]) - both.mean(axis=0)) / both.std(axis=0)
    density = {}
    for c, v in z.items():
        cov = np.cov(v.T, bias=True)
        cov = 0.8 * cov + 0.2 * np.trace(cov) / 3 * np.eye(3)
        d = point[0] - v.mean(axis=0)
        density[c] = -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1]) + np.log(len(v) / 800)
    want = 1 / (1 + np.exp(density[0] - density[1]))
    assert abs(model.score(np.array([[0.3, -0.2, 1.0]]))[0] - want) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "x y z", 0), (2, "long " * 50000, 0), (3, "\x00\x01", 0)], "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 1), (None, 0)], "doc_id bigint, quality int")
    got = qc.classify(docs, labels).collect()
    assert len(got) == 5 and all(r["score"] == 1.0 for r in got)  # one class only
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [True]
    none = qc.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qc.classify(docs.limit(0), labels).count() == 0
    more = spark.createDataFrame([(i, "good words in a sentence. " * 5 if i % 2 else "### $$$ %%% " * 9) for i in range(60)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    assert all(r["predicted"] == r["doc_id"] % 2 for r in qc.classify(more, marks).collect())
