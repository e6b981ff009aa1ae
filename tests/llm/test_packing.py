import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscan.llm import packing
from loomscan.llm.packing import LevelPacker


def squares(levels):
    return int((levels.astype(object) ** 2).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_pieces_cover_documents_and_windows(sizes):
    packer, windows = LevelPacker(16), []
    for i, n in enumerate(sizes):
        windows += packer.add(i, np.arange(n, dtype="<u4") + 1000 * i)
    windows += packer.finish()
    seen = {i: np.zeros(n, dtype=int) for i, n in enumerate(sizes)}
    for w in windows:
        length = sum(len(p[2]) for p in w)
        assert length == 16 or length & (length - 1) == 0
        for key, start, ids, total in w:
            assert total == sizes[key] and len(ids)
            assert (ids == np.arange(start, start + len(ids)) + 1000 * key).all()
            seen[key][start : start + len(ids)] += 1
    assert all((x == 1).all() for x in seen.values())
    assert sum(len({id(w)}) for w in windows if sum(len(p[2]) for p in w) < 16) <= 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=15, max_size=15), st.integers(1, 15))
def test_level_minimises_squares(counts, size):
    packer = LevelPacker(16)
    packer.levels[1:16] = counts
    chosen = packer.choose(size)

    def after(h):
        levels = packer.levels.copy()
        if h:
            levels[h] -= 1
        if h + size < 16:
            levels[h + size] += 1
        return squares(levels)

    options = [h for h in range(16 - size + 1) if h == 0 or packer.levels[h]]
    assert chosen in options
    assert after(chosen) == min(map(after, options))


def placed(sizes, capacity):
    """Windows of a partition as lists of (key, start, length): those completed online, and those left open, by trying every level anew for each document."""
    full, levels, open_windows = [], [0] * capacity, {}
    for key, total in enumerate(sizes):
        start = 0
        while total - start >= capacity:
            full.append([(key, start, capacity)])
            start += capacity
        size = total - start
        if not size:
            continue
        best = None
        for level in range(capacity - size, -1, -1):  # ties go to the fullest
            if level and not levels[level]:
                continue
            then = list(levels)
            if level:
                then[level] -= 1
            if level + size < capacity:
                then[level + size] += 1
            cost = sum(x * x for x in then[1:])
            if best is None or cost < best[0]:
                best = (cost, level, then)
        _, level, levels = best
        window = [*(open_windows[level].pop() if level else []), (key, start, size)]
        if level + size == capacity:
            full.append(window)
        else:
            open_windows.setdefault(level + size, []).append(window)
    return full, [w for ws in open_windows.values() for w in ws]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.lists(st.integers(1, 70), max_size=80), st.lists(st.integers(17, 31), max_size=120), st.lists(st.sampled_from([5, 11, 16, 21]), max_size=120)))
def test_a_whole_partition_against_brute_force(sizes):
    packer, online = LevelPacker(32), []
    for i, n in enumerate(sizes):
        online += packer.add(i, np.arange(n, dtype="<u4"))
    shape = lambda ws: [[(key, start, len(ids)) for key, start, ids, _ in w] for w in ws]
    full, left = placed(sizes, 32)
    assert shape(online) == full
    assert sorted(shape(w for ws in packer.open.values() for w in ws)) == sorted(left)
    settled = list(packer.finish())
    lengths = sorted(sum(len(p[2]) for p in w) for w in settled)
    rest = sum(n for w in left for _, _, n in w)
    assert lengths.count(32) == rest // 32 and sum(lengths) == rest
    assert [n for n in lengths if n < 32] == [1 << k for k in range(5) if rest % 32 >> k & 1]


def test_many_windows_stay_open_until_the_end():
    """No two of these documents fit one window: all stay open, none is settled early."""
    packer, rng = LevelPacker(), np.random.default_rng(1)
    sizes = rng.integers(520, 1001, 20000)
    assert not any(w for n in sizes.tolist() for w in packer.add(0, np.zeros(n, dtype="<u4")))
    assert packer.levels.sum() == 20000
    assert sum(len(p[2]) for w in packer.finish() for p in w) == sizes.sum()


def test_ids_are_those_of_the_tokenizer(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = packing.json_tokenizer(packing.vocabulary_path("byte_bpe_50k.json"))
    pieces = {}
    for r in packing.pack(rows).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert pieces.keys() == texts.keys()
    for key, text in list(texts.items())[:300]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(pieces[key], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == ids.tobytes()
        assert all(r["doc_tokens"] == len(ids) for r in own)
    sequences = {}
    for r in (x for xs in pieces.values() for x in xs):
        sequences.setdefault(r["sequence_id"], []).append(r)
    short = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        total = sum(r["length"] for r in own)
        assert total == own[0]["sequence_tokens"] <= 1024
        short += total < 1024
    assert short <= 10 * rows.rdd.getNumPartitions()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a " * 5000, "x"), (3, "a " * 5000, "x"), (None, "b", "x"), (4, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").coalesce(1)
    found = packing.pack(df).collect()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert [bytes(r["ids"]) for r in by[1]] == [bytes(4)] == [bytes(r["ids"]) for r in by[2]]
    assert sum(r["length"] for r in by[3]) == 2 * by[3][0]["doc_tokens"]
    assert by[None][0]["doc_tokens"] == 2 and by[4][0]["doc_tokens"] > 2
    assert packing.pack(df.limit(0)).count() == 0


def test_query_digests(spark, small_dir):
    from loomscan.llm.queries import op2_packing

    got = op2_packing(spark, small_dir).collect()
    ids = {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in packing.pack(spark.read.parquet(f"{small_dir}/documents.parquet")).collect()}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"], r["start"]]) for r in got)
