import regex
from hypothesis import example, given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN

from loomscan.llm import token_counts
from loomscan.llm.packing import byte_bpe, vocabulary_path
from loomscan.llm.token_counts import DocumentTree, PieceCounts, redactions

ENCODE = byte_bpe(vocabulary_path(), vocabulary_path("byte_bpe_50k.json"))
SPLIT = regex.compile(PATTERN).findall
COUNTS = PieceCounts(ENCODE)
TEXT = st.text(alphabet=" \n'slrevdab1é.!", max_size=60)


@settings(max_examples=400, deadline=None)
@example("1a1", [(0, 3, ""), (0, 0, ""), (0, 0, "b")], 1)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 70), st.integers(-2, 70), st.text(alphabet=" \n'slreva1.", max_size=8)), max_size=6), st.sampled_from([1, 2, 5, 64]))
def test_edits_count_as_whole_texts_do(text, edits, leaf):
    tree = DocumentTree(text, SPLIT, COUNTS, leaf)
    assert tree.total == len(ENCODE(text))
    for start, end, new in edits:
        tree.edit(start, end, new)
        a = max(0, min(start, len(text)))
        b = max(a, min(end, len(text)))
        text = text[:a] + new + text[b:]
        assert tree.text() == text
        assert [p for x in tree.leaves for p in x] == SPLIT(text)
        assert tree.total == len(ENCODE(text)) and tree.chars[1] == len(text)


def test_small_edits_recount_little():
    text = "Some words of a text, all of them short. " * 2000
    tree = DocumentTree(text, SPLIT, COUNTS)
    tree.edit(40000, 40004, "changed")
    assert tree.text() == text[:40000] + "changed" + text[40004:]
    assert tree.total == len(ENCODE(tree.text())) and tree.recounted < 10


def test_redactions_keep_the_rest():
    text = "Mail a.b@example.com now.\nline\nother +12 345 67890 x\nline\n\nline"
    for start, end, new in redactions(text):
        text = text[:start] + new + text[end:]
    assert text == "Mail <masked> now.\nline\nother +<masked> x\n\n"


def test_query_against_whole_counts(spark, sf_dir):
    from loomscan.llm.queries import op1_token_counts

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    edited = {r["doc_id"]: r for r in token_counts.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert op1_token_counts(spark, sf_dir).count() == len(docs) == len(edited)
    assert any(r["n_edits"] for r in edited.values())
    for i, text in docs.items():
        r = edited[i]
        assert r["n_tokens"] == len(ENCODE(text)) and r["n_tokens_after"] == len(ENCODE(r["edited_text"]))
        for start, end, new in redactions(text):
            text = text[:start] + new + text[end:]
        assert r["edited_text"] == text


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (1, "", [(0, 0, "new")], 1), (None, "a b", [(1, 9, None), (0, 0, "x")], 1), (2, "word " * 50000, [], 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, e array<struct<start:int,end:int,new:string>>, n_tokens int")
    got = {(r["doc_id"], r["n_edits"]): r for r in token_counts.count_tokens(df, edits_col="e").collect()}
    assert got[1, 0]["n_tokens"] == 0 and got[1, 1]["edited_text"] == "new" and got[None, 2]["edited_text"] == "xa"
    assert got[2, 0]["n_tokens"] == got[2, 0]["n_tokens_after"] > 50000
    assert token_counts.count_tokens(df.limit(0)).count() == 0
