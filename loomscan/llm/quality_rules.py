"""Line-first quality rules, in DataFrame functions only.

Every line is judged on its own by punctuation, navigation and boilerplate rules; failing lines are removed; a document that
loses too much of its text by that, or fails the base rules, is rejected. All of it is one projection over the scan: no
shuffle, no Python.

Defined results: a null or empty text has no words and is rejected; repeated rows are judged each; an empty table gives no
rows; columns of the input keep their names and values, and the columns added here are dropped from the input first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import SPACE_CHARS, own_prefix, words

MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Of the characters in words, the share that may be lost with removed lines.
MAX_LOST = 0.3
#: A line fails from so many symbols or separators in proportion to its words on.
SYMBOLS_PER_WORD = 0.5
SEPARATORS_PER_WORD = 0.25
SHOUTS_PER_WORD = 0.5
#: Lines of so many words and more need a mark that ends a sentence or clause.
UNPUNCTUATED_WORDS = 30
SYMBOL_CLASS = "[#*$%&|<>]"
SEPARATOR_CLASS = "[|»›•·]"
SHOUT_CLASS = "[!]"
MARK_CLASS = "[.,;:!?…。！？]"
#: Phrases of lines that many sites share, and labels that make up menus.
BOILERPLATE = "(?i)(all rights reserved|licensed under|terms of (use|service)|privacy policy|cookie|enable javascript|subscribe to our|sign up for|follow us on|powered by|©)"
NAVIGATION = "(?i)^(home|menu|log ?in|log ?out|sign ?in|sign ?up|register|search|next|previous|back|top|contact|about|sitemap|share|print|skip to content)[ >:|]*$"

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept_text", "kept"]


#: What a text must hold, in lower case, for one of its lines to match BOILERPLATE.
BOILERPLATE_SIGNS = ["all rights reserved", "licensed under", "terms of ", "privacy policy", "cookie", "enable javascript", "subscribe to our", "sign up for", "follow us on", "powered by", "©"]


def holds_any(text: Column, signs: list[str]) -> Column:
    return reduce(Column.__or__, [text.contains(x) for x in signs])


def count_of(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def line_fails(line: Column, n: Column, may: dict[str, Column] | None = None) -> Column:
    """True if one of the rules removes the line of n words. Blank lines stay. may: whether the text holds what a rule looks for at all."""
    may = may or {}
    held = lambda name, rule: may[name] & rule if name in may else rule
    punctuation = held("symbols", count_of(line, SYMBOL_CLASS) > SYMBOLS_PER_WORD * n) | held("shouts", (count_of(line, SHOUT_CLASS) > SHOUTS_PER_WORD * n) & (n >= 3)) | (n >= UNPUNCTUATED_WORDS) & ~line.rlike(MARK_CLASS)
    navigation = held("separators", count_of(line, SEPARATOR_CLASS) > SEPARATORS_PER_WORD * n) | F.btrim(line, F.lit(SPACE_CHARS)).rlike(NAVIGATION)
    return (n > 0) & (punctuation | navigation | held("boilerplate", line.rlike(BOILERPLATE)))


def judge(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED, max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of docs with the counts, lost_chars, kept_text (the text without removed lines) and kept."""
    text, own = F.coalesce(F.col(text_col), F.lit("")), own_prefix(docs)
    # Each select names what the next one refers to more than once, inside lambdas too, so that nothing is worked out anew
    # for every element.
    split = docs.drop(*[c for c in ADDED if c != text_col]).select(
        "*",
        words(text).alias(own + "words"),
        F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit("[^ \\t-\\r]+")).alias("n"))).alias(own + "lines"),
        count_of(text, SYMBOL_CLASS).cast("bigint").alias("n_symbols"),
        text.contains("!").alias(own + "shouts"),
        holds_any(text, list("|»›•·")).alias(own + "separators"),
        holds_any(F.lower(text), BOILERPLATE_SIGNS).alias(own + "boilerplate"),
    )
    may = {"symbols": F.col("n_symbols") > 0, "shouts": F.col(own + "shouts"), "separators": F.col(own + "separators"), "boilerplate": F.col(own + "boilerplate")}
    hashed = split.select(
        "*",
        F.size(own + "words").cast("bigint").alias("n_words"),
        F.filter(own + "lines", lambda x: x["n"] > 0)["line"].alias(own + "full"),
        F.transform(own + "words", lambda w: F.xxhash64(w)).alias(own + "hashes"),
        F.array_join(F.filter(own + "lines", lambda x: ~line_fails(x["line"], x["n"], may))["line"], "\n").alias("kept_text"),
    )
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - 3)
    windowed = hashed.select("*", F.when(F.col("n_words") >= 3, F.transform(at, lambda i: F.xxhash64(F.get(own + "hashes", i), F.get(own + "hashes", i + 1), F.get(own + "hashes", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias(own + "windows"))
    # windows in order only where some are repeated
    ordered = windowed.select("*", F.when(F.size(F.array_distinct(own + "windows")) < F.size(own + "windows"), F.sort_array(F.transform(own + "windows", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).otherwise(F.array().cast("array<struct<k:bigint,i:int>>")).alias(own + "pairs"))
    doubled = F.filter(own + "pairs", lambda p, j: (F.coalesce(F.get(own + "pairs", j - 1)["k"] == p["k"], F.lit(False))) | (F.coalesce(F.get(own + "pairs", j + 1)["k"] == p["k"], F.lit(False))))
    counted = ordered.select(
        "*",
        F.char_length(F.array_join(own + "words", "")).cast("bigint").alias("word_chars"),
        (F.size(own + "full") - F.size(F.array_distinct(own + "full"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct(F.flatten(F.transform(doubled, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))).cast("bigint").alias("n_repeat_words"),
        F.char_length(F.translate("kept_text", SPACE_CHARS, "")).alias(own + "left"),
    )
    judged = counted.select(
        "*",
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") - F.col(own + "left")).cast("bigint").alias("lost_chars"),
    )
    # A filter on these columns must not move below the selects above: it would work out their expressions again, each inside
    # the next. It doesn't pass a column that isn't deterministic, so one condition, always true, is of that kind.
    here = F.monotonically_increasing_id() >= 0
    return judged.select("*", (here & ~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept")).drop(own + "words", own + "lines", own + "full", own + "hashes", own + "windows", own + "pairs", own + "left", own + "shouts", own + "separators", own + "boilerplate")
