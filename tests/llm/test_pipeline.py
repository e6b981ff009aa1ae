import zlib

import numpy as np
from test_line_dedup import slow as slow_lines
from test_near_copies import slow as slow_copies
from test_substring_dedup import slow as slow_windows

import corpus_pipeline
from loomscan.llm import quality_rules
from loomscan.llm.line_dedup import MIN_SITES, MIN_WORDS, SHORT_SITES
from loomscan.llm.packing import json_tokenizer, vocabulary_path


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    now = {i: (r["source"], r["kept_text"]) for i, r in judged.items() if r["kept"]}
    counts = [len(now)]
    kept = slow_lines([(i, s, t) for i, (s, t) in now.items()], MIN_SITES, MIN_WORDS, SHORT_SITES)
    now = {i: (now[i][0], t) for i, _, _, t in kept if t.strip()}
    counts.append(len(now))
    heads, _ = slow_copies([(i, t) for i, (_, t) in now.items()])
    now = {i: x for i, x in now.items() if heads[i] == i}
    counts.append(len(now))
    kept = slow_windows([(i, t) for i, (_, t) in now.items()], 20)
    now = {i: words for i, _, _, words in kept if words}
    counts.append(len(now))
    assert 300 < counts[3] <= counts[2] < counts[1] <= counts[0] < 1000

    rows = docs
    for n, (_, stage) in zip(counts, corpus_pipeline.STAGES[:-1], strict=True):
        rows = stage(spark, rows, sf_dir).cache()
        assert rows.columns == docs.columns and rows.count() == n
        assert rows.filter("n_chars <> char_length(text)").count() == 0
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert {i: " ".join(t.split()) for i, t in texts.items()} == now

    tokenizer = json_tokenizer(vocabulary_path("byte_bpe_50k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        assert sum(r["length"] for r in pieces[i]) == len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in pieces[i])


def test_rows_that_share_an_id(spark):
    """Two texts under one id are two documents: neither loses by what the other shares with the rest."""
    own = lambda c: "\n".join(" ".join(f"{c}{i}x{j}" for j in range(12)) + "." for i in range(12))
    copied, unique = own("Alpha"), own("Beta")
    rows = [(1, copied, "en", "a", 0), (3, copied, "en", "b", 0), (3, unique, "en", "b", 0), (3, unique, "en", "b", 0), (4, copied + "\nOne more line.", "en", "c", 0)]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert (3, unique) in {(r["doc_id"], r["text"]) for r in now.collect()}, name
    assert sorted((r["doc_id"], r["text"]) for r in now.collect()) == [(1, copied), (3, unique)]


def test_very_long_text(spark):
    long = "\n".join(f"Sentence number {i} of a very long text, word{i * 7919 % 100003} and word{i * 104729 % 99991}." for i in range(20000))
    rows = [(1, long, "en", "a", 0), (2, long + "\nand an end.", "en", "b", 0)]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
    assert [(r["doc_id"], r["text"]) for r in now.collect()] == [(1, long)]


def test_odd_rows(spark):
    text = " ".join(f"Alpha{i} beta{i} gamma{i}." for i in range(30))
    rows = [(1, text, "en", "a", 1, 0), (1, text, "en", "a", 1, 0), (2, text, None, None, None, 0), (3, None, "en", "a", 0, 0), (4, "", "en", "a", 0, 0)]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert {r["doc_id"] for r in now.collect()} == {1}
    empty = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
