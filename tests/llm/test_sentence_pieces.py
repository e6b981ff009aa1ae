import math

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomscan.llm import sentence_pieces
from loomscan.llm.sentence_pieces import Pieces, Segmenter, vocabulary_path

MODEL = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())
PIECES = Pieces.load(vocabulary_path())
SMALL = Pieces([("<unk>", 0.0, False), *((f"<0x{b:02X}>", 0.0, True) for b in range(256)), ("a", -3.0, True), ("b", -3.5, True), ("ab", -5.0, True), ("ba", -5.25, True), ("aba", -7.0, True), ("▁", -2.0, True), ("▁a", -4.5, True), ("▁▁", -3.0, True)])


def every(pieces, text):
    """All segmentations of a text as (score, ids)."""
    escaped = "▁" + text.replace(" ", "▁") if text else ""
    into, _ = pieces.lattice(escaped)

    def to(end):
        if end == 0:
            yield 0.0, ()
        for start, score, ids in into[end]:
            for s, x in to(start):
                yield s + score / pieces.unit, x + ids

    return sorted(to(len(escaped)), key=lambda x: -x[0])


def ordered(pieces, text):
    """All segmentations as (score, ids) in the order that the module promises: by score, then the longer of the last pieces that differ."""
    escaped = "▁" + text.replace(" ", "▁") if text else ""
    into, _ = pieces.lattice(escaped)

    def to(end):
        if end == 0:
            yield 0, (), ()
        for start, score, ids in into[end]:
            for s, x, lengths in to(start):
                yield s + score, x + ids, (start - end, *lengths)

    return [(s / pieces.unit, x) for s, x, _ in sorted(to(len(escaped)), key=lambda x: (-x[0], x[2]))]


#: Nearly every choice in this vocabulary is a tie, inside segments and between them.
TIES = Pieces([("<unk>", 0.0, False), *((f"<0x{b:02X}>", 0.0, True) for b in range(256)), *((p, -float(len(p)), True) for p in ("a", "b", "%", "▁", "ab", "ba", "aba", "bab", "%%", "%%%", "▁a", "▁%", "aa"))])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab% ", max_size=9), st.integers(1, 7))
def test_order_of_ties(text, n):
    assert unpacked(Segmenter(TIES, n).encode(text)) == ordered(TIES, text)[:n]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=9), st.integers(1, 6))
def test_order_of_all(text, n):
    assert unpacked(Segmenter(SMALL, n).encode(text)) == ordered(SMALL, text)[:n]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["ab", "ba", "aab", "%%", "a", "b%b"]), min_size=1, max_size=5), st.integers(1, 4), st.sampled_from([SMALL, TIES]))
def test_order_with_repeated_segments(words, n, pieces):
    """The same losses many times over, above zero and at zero."""
    text = " ".join(words)
    text = text if len(text) <= 11 else text[:11]
    assert unpacked(Segmenter(pieces, n).encode(text)) == ordered(pieces, text)[:n]


def test_a_word_has_one_best_segmentation_for_every_n_and_place():
    for pieces, word in ((PIECES, "ci%%%"), (TIES, "abab%%%")):
        best = unpacked(Segmenter(pieces, 1).encode(word))[0][1]
        for n in (1, 2, 3, 5):
            assert unpacked(Segmenter(pieces, n).encode(word))[0][1] == best
            again = unpacked(Segmenter(pieces, n).encode(" ".join([word] * 4)))[0][1]
            assert again == best * 4 or len(best) * 4 == len(again)


def test_length_of_a_segment_doesn_t_change_its_segmentations(monkeypatch):
    texts = ["aba" * 20, "abaab" * 9 + "%%%" * 5, "b" + "ab" * 24, "xé" + "ab" * 22]
    want = [unpacked(Segmenter(TIES, 3).encode(t)) for t in texts]
    monkeypatch.setattr(sentence_pieces, "ARRAY_LENGTH", 10**6)
    assert [unpacked(Segmenter(TIES, 3).encode(t)) for t in texts] == want


def test_long_segments_of_ties_take_linear_time():
    import time

    began = time.time()
    found = TIES.n_best("ab" * 10000, 3)
    assert time.time() - began < 20 and len(found) == 3 and len({x[1] for x in found}) == 3


def unpacked(found):
    return [(s, tuple(x.tolist())) for s, x, _ in found]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n", max_size=9), st.integers(1, 6))
def test_n_best_of_all_segmentations(text, n):
    want = every(SMALL, text)
    got = unpacked(Segmenter(SMALL, n).encode(text))
    assert len(got) == min(n, len(want)) and len(set(got)) == len(got)
    assert all(math.isclose(a[0], b[0], abs_tol=1e-9) for a, b in zip(got, want, strict=False))
    known = {x: s for s, x in want}
    assert all(math.isclose(known[x], s, abs_tol=1e-9) for s, x in got)
    assert all(SMALL.decode(x) == text for _, x in got)


def test_best_scores_of_words_of_the_vocabulary():
    for text in ("the", "xylophone", "été", "a b", "1999!", "ab\ncd"):
        want = every(PIECES, text)[:4]
        got = unpacked(Segmenter(PIECES, 4).encode(text))
        assert [s for s, _ in got] == [s for s, _ in want]


def test_no_piece_crosses_a_cut():
    assert PIECES.cut.pattern != r"(?s:.+)"


def test_decoding_is_the_models(sf_dir):
    import pyarrow.parquet as pq

    segmenter = Segmenter(PIECES, 3)
    for text in [*pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()[:80], " lead", "trail ", "two  spaces", "日本語\t🙂", "▁"]:
        for _, ids, n in segmenter.encode(text):
            ids = ids.tolist()
            assert len(ids) == n and PIECES.decode(ids) == MODEL.decode(ids)
            assert PIECES.decode(ids) == text.replace("▁", " ")


def test_query_round_trip(spark, sf_dir):
    import hashlib

    from loomscan.llm.queries import op10_sentence_pieces

    texts = {r["doc_id"]: hashlib.md5(r["text"].encode()).hexdigest() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op10_sentence_pieces(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    assert all(r["decoded_md5"] == texts[r["doc_id"]] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], {})[r["rank"]] = r
    assert all(list(sorted(x)) == list(range(1, len(x) + 1)) for x in by.values())
    assert all(x[k]["score"] >= x[k + 1]["score"] for x in by.values() for k in range(1, len(x)))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a", 0), (2, "x" * 30000, 0)], "doc_id bigint, text string, rank int")
    got = sentence_pieces.decode(sentence_pieces.encode(df)).collect()
    assert sorted((r["rank"], r["n_pieces"], r["score"], r["decoded"]) for r in got if r["doc_id"] == 1) == [(1, 0, 0.0, "")] * 2
    assert all(r["decoded"] == "x" * 30000 for r in got if r["doc_id"] == 2)
    assert [r["decoded"] for r in got if r["doc_id"] is None][0] == "a"
    assert sentence_pieces.encode(df.limit(0)).count() == 0
    once = sentence_pieces.encode(df, decoded=True)
    assert once.columns == sentence_pieces.decode(sentence_pieces.encode(df)).columns
    assert sorted(map(str, once.collect())) == sorted(map(str, got))
