from collections import Counter

from oracle import same

from loomscan.llm import quality_rules


def slow(text):
    lines = (text or "").split("\n")
    words = (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in lines if x.strip(" \t\n\x0b\f\r")]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
CLEAN = " ".join(f"Alpha{i} beta{i} gamma{i} words{i} end{i}." for i in range(20))


def test_base_counts(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200).collect()]
    texts += [None, "", " ", "a", "a b", "a b c", "a b c a b c", "x\n\nx\n x\n", "ä ö ü " * 30, "a a a a", "\x0bq\x0cr", "w " * 30000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.judge(df).collect():
        assert tuple(r[c] for c in COLUMNS) == slow(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_query_against_sql(spark, sf_dir):
    from loomscan.llm.queries import ORACLE_SQL, op8_quality_rules

    assert same(op8_quality_rules(spark, sf_dir), ORACLE_SQL["op8_quality_rules"], sf_dir) == 1000


def test_line_rules(spark):
    rows = [
        (1, CLEAN),
        (2, CLEAN + "\nHome | Products | About | Contact\nAll rights reserved by us."),
        (3, "\n".join(["Home | Products | About | Contact"] * 1 + [f"Item{i} | a{i} | b{i} | c{i}" for i in range(40)])),
        (4, " ".join(f"word{i}###" for i in range(80))),
        (5, " ".join(f"WORD{i}!!" for i in range(80))),
        (6, " ".join(f"word{i}" for i in range(80))),
    ]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i]["kept"] for i in range(1, 7)] == [True, True, False, False, False, False]
    assert got[2]["kept_text"] == CLEAN and got[2]["lost_chars"] > 0 and got[1]["lost_chars"] == 0


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, CLEAN, True, 1), (1, None, None, 2), (1, None, None, 2)], "doc_id bigint, text string, kept boolean, n_words int")
    got = quality_rules.judge(df).collect()
    assert sorted((str(r["doc_id"]), r["kept"], r["kept_text"] == "") for r in got) == [("1", False, True), ("1", False, True), ("None", True, False)]
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_plan_is_native(spark, small_dir):
    from loomscan.llm.queries import op8_quality_rules

    plan = op8_quality_rules(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def slow_kept(text):
    """(kept, lost characters, kept text), line by line in Python."""
    import re

    blank = " \t\n\x0b\f\r"
    of = lambda x, chars: sum(c in chars for c in x)
    kept, lost = [], 0
    for line in (text or "").split("\n"):
        n = len([w for w in re.split("[ \t-\r]+", line) if w])
        bare = line.strip(blank)
        fails = n > 0 and (
            of(line, "#*$%&|<>") > 0.5 * n
            or (n >= 3 and of(line, "!") > 0.5 * n)
            or (n >= 30 and not re.search("[.,;:!?…。！？]", line))
            or of(line, "|»›•·") > 0.25 * n
            or re.search(quality_rules.NAVIGATION, bare, re.A) is not None
            or re.search(quality_rules.BOILERPLATE, line, re.A) is not None
        )
        if fails:
            lost += sum(c not in blank for c in line)
        else:
            kept.append(line)
    return lost, "\n".join(kept)


def test_kept_text_against_brute_force(spark, sf_dir):
    """Documents, every sign of boilerplate in every case, every kind of failing line, and a very long text."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300).collect()]
    signs = ["ALL RIGHTS RESERVED", "Licensed Under x", "terms of use", "Terms of Service", "terms of trade", "Privacy Policy", "Cookies", "Enable JavaScript", "Subscribe to our", "SIGN UP FOR", "Follow us on", "Powered by", "© 2024", "ſubscribe to our", "COOKIE", "Cooкie"]
    texts += [f"{CLEAN}\n{s}\n{CLEAN}" for s in signs]
    lines = ["a ! b ! c !", "! ! !", "x! y! z", "a » b", "a • b c d e f g h", "Home", " log in >", "skip to content:", "contact us", "#a b", "##", "w " * 30, "w " * 30 + ".", "\t", "\x0b|\x0c", "a|b c d e"]
    texts += [f"{CLEAN}\n{x}" for x in lines] + ["\n".join(lines), "\n".join(lines * 4000), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = quality_rules.judge(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lost, kept = slow_kept(texts[r["doc_id"]])
        assert (r["lost_chars"], r["kept_text"]) == (lost, kept), texts[r["doc_id"]][:300]
        assert r["kept"] == (not r["base_failed"] and lost <= 0.3 * r["word_chars"])
