import random

import pytest
from oracle import same
from pyspark.sql import functions as F

from loomscan.llm import line_dedup


def slow(rows, min_sites, min_words=1, short_sites=None):
    """(id, lines with a word, lines removed, kept text) of (id, site, text) rows."""
    sites, first = {}, {}
    for i, site, text in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            t = line.strip(" \t\n\x0b\f\r")
            if t and (short_sites or len(t.split()) >= min_words):
                sites.setdefault(t, set()).add(site)
                first[t] = min(first.get(t, (i, pos)), (i, pos))
    bad = {t for t, s in sites.items() if len(s - {None}) >= (min_sites if len(t.split()) >= min_words else short_sites)}
    out = []
    for i, _, text in rows:
        lines = (text or "").split("\n")
        gone = [k for k, x in enumerate(lines) if (t := x.strip(" \t\n\x0b\f\r")) in bad and first[t] != (i, k)]
        out.append((i, sum(1 for x in lines if x.strip()), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(3)
    lines = [f"line number {i} of them all" for i in range(30)] + [" padded line of five words\t", "", "short"]
    rows = [(i, rng.choice([None, *[f"s{j}" for j in range(9)]]), "\n".join(rng.choice(lines[: rng.randint(2, 33)]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    rows += [(500, "s1", None), (501, "s2", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3)
    got = line_dedup.remove_boilerplate(df, min_sites=5).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in got) == sorted(slow(rows, 5, 5))


def test_many_sites_go_by_sketches(spark):
    """Far more sites than a sketch keeps apart exactly: lines well over, well under and near the threshold."""
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("site"), "id").alias("source"), F.concat_ws("\n", F.lit("a line on all the sites"), F.when(F.col("id") < 3000, "a line on exactly enough sites"), F.when(F.col("id") < 2999, "a line on one site less"), F.when(F.col("id") < 50, "a line on very few sites")).alias("text"))
    got = line_dedup.remove_boilerplate(rows, min_sites=3000).select("doc_id", "n_removed", "kept_text").collect()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_removed"] == 0 and by[0]["kept_text"].count("\n") == 3
    assert by[1]["kept_text"] == "a line on one site less\na line on very few sites"
    assert by[2999]["kept_text"] == "" and by[8999]["n_removed"] == 1


def test_query_against_sql(spark, sf_dir):
    from loomscan.llm.queries import ORACLE_SQL, op7_line_dedup

    assert same(op7_line_dedup(spark, sf_dir), ORACLE_SQL["op7_line_dedup"], sf_dir) == 1000


def test_odd_rows(spark):
    line = "the same five words here"
    rows = [(None, "a", line, 1), (1, None, line, 1), (2, "b", line, 1), (2, "b", line, 1), (3, "c", line + "\n" + line, 1), (4, "d", None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, n_lines int")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_boilerplate(df, min_sites=3).collect()), key=str)
    assert got == sorted([(None, 1, 0), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 2, 2), (4, 0, 0)], key=str)
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark, tmp_path):
    """Another text under the same id: what is removed of one row doesn't touch the other. Held against the query's SQL."""
    from loomscan.llm.queries import ORACLE_SQL, op7_line_dedup

    common = "a line that all sites of this table share"
    rows = [(i, f"s{i}", common) for i in range(8)] + [(3, "s1", "unique content that must not be removed"), (3, "s1", f"first an own line\n{common}"), (0, "s2", f"x\n{common}\ny")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert same(op7_line_dedup(spark, str(tmp_path)), ORACLE_SQL["op7_line_dedup"], views={"documents": str(tmp_path / "documents.parquet")}) == len(rows)


def test_very_long_text_and_short_lines_against_brute_force(spark):
    """A text of many lines, and short lines on sites around their own threshold."""
    long = "\n".join(f"line {i % 5000} of a very long text" for i in range(60000))
    rows = [(1, "s1", long), *[(10 + i, f"s{i}", "\n".join(["Read it"] + ["Seen on one less"] * (i < 11) + [f"line {i} of a very long text"])) for i in range(12)]]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), short_sites=12)
    kept = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in got.collect()}
    assert kept[1] == (0, long)
    assert kept[10][0] == 0 and kept[11] == (1, "Seen on one less\nline 1 of a very long text")
