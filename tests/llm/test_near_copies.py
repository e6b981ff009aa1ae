import random

import numpy as np

import corpus_pipeline
from loomscan.llm import near_copies


def texts():
    """Documents of 200 words in families, whose members have few words changed, and some short or empty ones."""
    rng = random.Random(8)
    rows = []
    for family in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for changes in (0, 0, 1, 2, 3, 4, 5, 6, 9):
            now = list(base)
            for i in rng.sample(range(200), changes):
                now[i] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(now)))
    return rows + [(1000 + i, t) for i, t in enumerate(["", None, "one two", "One  two", "one two three four five", " "])]


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) <= size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def slow(rows, similarity=0.8):
    """(heads by id, pairs of distinct sets at the similarity)."""
    sets, head, pairs = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}, []

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])):
                pairs += [(i, j)] if sets[i] != sets[j] else []
                a, b = root(i), root(j)
                head[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, pairs


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, pairs = slow(rows)
    assert len(pairs) > 100
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == want


def test_pipeline_stage_drops_pairs_at_the_similarity(spark):
    """Pairs of at least 0.8 whose op9 fingerprints lie more than 4 bits apart: the stage left both in before."""
    from loomscan.llm import simhash

    rows = [(i, t) for i, t in texts() if i < 1000]
    want, pairs = slow(rows)
    text = dict(rows)
    assert sum((simhash.fingerprint(text[i].encode()) ^ simhash.fingerprint(text[j].encode())).bit_count() > 4 for i, j in pairs) > 20
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {i for i, h in want.items() if h == i}


def test_links_are_checked():
    """Sets in one group that are less alike than the similarity stay apart, and chains link."""
    a = near_copies.shingles(b" ".join(b"%d" % i for i in range(100)))
    assert near_copies.spanning_links([a, a[:76]]) == []
    assert near_copies.spanning_links([a, a[:77]]) == [(0, 1)]
    assert near_copies.spanning_links([a[:62], a, a[:77]]) == [(0, 2), (2, 1)]


def test_odd_rows(spark):
    rows = [(None, "x y"), (1, "x y"), (1, "x y"), (2, "X y"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r["doc_id"] for r in near_copies.one_of_each(df).collect()), key=str) == [1, 3, None]
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_other_texts_under_an_id_stay(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(3, first), (3, second), (3, second), (5, first + " x"), (6, second + " y"), (7, "own words only here in this one")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted((r["doc_id"], r["text"]) for r in near_copies.one_of_each(df).collect()) == sorted([rows[0], rows[1], rows[5]])


def test_large_groups_in_blocks(spark, monkeypatch):
    """Groups beyond the size for one task, with members that the least one isn't alike to: the components are those of brute force."""
    monkeypatch.setattr(near_copies, "GROUP", 3)
    monkeypatch.setattr(near_copies, "GROUP_BLOCK", 2)
    rows = texts()
    rng = random.Random(2)
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):  # each alike to the next, the ends not to each other
        chain = list(chain)
        for at in rng.sample(range(120), 2):
            chain[at] = f"d{i}{at}"
        rows.append((2000 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want, _ = slow(rows)
    assert len({want[2000 + i] for i in range(12)}) < 12
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df).collect()} == want


def test_candidates_come_from_covering_tables(spark, monkeypatch):
    """Fingerprints within the radius that the tables cover always meet, in buckets of every size; others only within the checked bits."""
    rng = np.random.default_rng(4)
    radius = near_copies.WORDS * 64 // near_copies.PART_BITS * (near_copies.PART_RADIUS + 1) - 1
    bits = [x for x in rng.integers(0, 2, (6, near_copies.WORDS * 64), dtype=np.uint8)]
    for b in list(bits):
        for n in (radius, radius, 60, 5, 1, 1, 1, 1):
            bits.append(b.copy())
            bits[-1][rng.choice(len(b), n, replace=False)] ^= 1
    prints = np.packbits(np.array(bits), axis=1, bitorder="little").view("<u8")
    met = near_copies.keys(prints)
    assert met.shape[1] == 224
    assert all((met[i] == met[6 + 8 * i + j]).any() for i in range(6) for j in range(8))
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node bigint, print binary").repartition(3)
    want = {i: i if i < 6 else (i - 6) // 8 for i in range(len(bits))}
    for run, large in ((64, 4096), (2, 4096), (2, 3)):
        monkeypatch.setattr(near_copies, "RUN", run)
        monkeypatch.setattr(near_copies, "LARGE", large)
        found = near_copies.components(near_copies.candidates(nodes))
        assert {r["node"]: r["component"] for r in found.collect()} == want


def test_pairs_at_the_similarity_meet():
    """Sets of a Jaccard similarity of exactly 0.8, the least one that counts: nearly all meet in a table and pass the check."""
    rng, missed = np.random.default_rng(5), 0
    for n in (9, 18, 90, 270):
        for _ in range(250):
            x = rng.integers(0, 1 << 64, n * 10 // 9, dtype=np.uint64)
            one, two = (near_copies.fingerprint(y) for y in (x[: n], x[n // 9 :]))
            k = near_copies.keys(np.stack([one, two]))
            alike = np.bitwise_count((one ^ two)[: near_copies.CHECK_WORDS]).sum() <= near_copies.CHECK_RADIUS
            missed += not (alike and (k[0] == k[1]).any())
    assert missed <= 2


def test_links_of_a_group_dont_grow_with_its_square(spark):
    """Sixty near copies, any two of which meet: a task emits less than one link for each of them, not one for each pair."""
    rng, n = np.random.default_rng(6), 60
    bits = np.repeat(rng.integers(0, 2, (1, near_copies.WORDS * 64), dtype=np.uint8), n, axis=0)
    for row in bits:
        row[rng.choice(len(row), 12, replace=False)] ^= 1
    prints = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    nodes = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "node bigint, print binary").repartition(3)
    links = near_copies.candidates(nodes)
    assert links.filter("a > b").count() == links.count() <= (n - 1) * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["component"] for r in near_copies.components(links).collect()} == {0}


def test_forests_connect_the_same(monkeypatch):
    """Links in many small arrays, thinned all at once or whenever a few are held: fewer links, the same components."""
    rng = np.random.default_rng(7)

    def heads(links):
        head = {}

        def root(x):
            while head.setdefault(x, x) != x:
                x = head[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            head[max(a, b)] = min(a, b)
        return {x: root(x) for x in list(head)}

    for n, m in ((3, 1), (50, 30), (300, 280), (300, 5000)):
        links = [tuple(x) for x in (rng.permutation(n)[:2] * 10**15 for _ in range(m))]
        want = heads(links)
        for held in (4, 100, 1 << 20):
            monkeypatch.setattr(near_copies, "HELD", held)
            arrays = [np.array(links[i : i + 7], dtype=np.int64).T for i in range(0, m, 7)]
            found = [(a, b) for x in near_copies.forests((a, b) for a, b in [(np.zeros(0, np.int64),) * 2, *arrays]) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
            assert heads(found) == want and all(a > b for a, b in found)
            assert len(found) <= m and (held < 1 << 20 or len(found) == len(want) - len(set(want.values())))
    assert list(near_copies.forests([])) == []
