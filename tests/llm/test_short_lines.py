import corpus_pipeline
from loomscan.llm import line_dedup


def planted():
    """Short lines on 12 and 11 sites, a line of five words on 6, and a blank line everywhere."""
    rows = []
    for i in range(12):
        lines = [f"own words of document {i} alone", "", "Read it all", "Share"] + ["Seen on one less"] * (i < 11) + ["five words on six sites"] * (i < 6)
        rows.append((i, "\n".join(lines), "en", f"site{i}", 0))
    return rows


def test_pipeline_counts_short_lines(spark):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"].split("\n") for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got[0] == ["own words of document 0 alone", "", "Read it all", "Share", "Seen on one less", "five words on six sites"]
    assert got[1] == ["own words of document 1 alone", "", "Seen on one less"]
    assert got[11] == ["own words of document 11 alone", ""]


def test_operator_leaves_short_lines_unless_told(spark):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["n_removed"] for r in line_dedup.remove_boilerplate(docs).filter("doc_id > 5").collect()} == {0}
    assert line_dedup.remove_boilerplate(docs, short_sites=12).filter("doc_id = 11").first()["n_removed"] == 2
