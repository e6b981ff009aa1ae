"""Every operator over tables with extra columns of every name that the operators use themselves."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomscan.llm import html_text, line_dedup, near_copies, neighbours, packing, quality_classifier, quality_rules, sentence_pieces, simhash, substring_dedup, token_counts

NAMES = set()
for path in Path(token_counts.__file__).parent.glob("*.py"):
    NAMES |= {n.lower() for n in re.findall(r'"(\w+)"', path.read_text()) if not n[0].isdigit()}


def wide(df):
    return df.select("*", *[F.lit("q").alias(n) for n in sorted({*NAMES, "__key", "__row", "__gone", "__words"} - set(df.columns))])


@pytest.fixture(scope="module")
def tables(spark):
    text = "Some words in a line of text number %d.\nAnother line here, all sites." * 3
    docs = spark.createDataFrame([(i, text % ((i % 3,) * 3), f"s{i}", "en", 10) for i in range(12)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    vectors = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(45)], "vec_id bigint, embedding array<float>")
    pages = spark.createDataFrame([(1, "u", "<p>hello world of words</p>")], "page_id bigint, url string, html string")
    return {"docs": wide(docs), "labels": wide(labels), "vectors": wide(vectors), "pages": wide(pages)}


@pytest.mark.parametrize(
    ("call", "rows"),
    [
        (lambda t: token_counts.count_tokens(t["docs"]), 12), (lambda t: packing.pack(t["docs"]).select("doc_id").distinct(), 12), (lambda t: quality_classifier.classify(t["docs"], t["labels"]), 12), (lambda t: substring_dedup.remove_repeats(t["docs"]), 12),
        (lambda t: html_text.extract(t["pages"]), 1), (lambda t: neighbours.nearest(t["vectors"]), 60), (lambda t: line_dedup.remove_boilerplate(t["docs"], short_sites=12), 12), (lambda t: quality_rules.judge(t["docs"]), 12), (lambda t: simhash.near_duplicates(t["docs"]), 12),
        (lambda t: simhash.one_of_each(t["docs"]), 3), (lambda t: near_copies.one_of_each(t["docs"]), 3), (lambda t: sentence_pieces.decode(sentence_pieces.encode(t["docs"])), 36),
    ],
)
def test_clashing_names(tables, call, rows):
    assert len(NAMES) > 150 and len(call(tables).collect()) == rows


def test_pipeline_drops_other_columns(spark, tables):
    now = tables["docs"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == corpus_pipeline.COLUMNS
