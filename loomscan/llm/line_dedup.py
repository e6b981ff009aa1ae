"""Removal of lines that many sites share.

Every line with a word is hashed; one aggregation gives each hash its first place and the HyperLogLog sketch of its sites
(combined before the shuffle, so a line that a third of all documents hold costs a sketch a task). Lines whose estimate is near
their threshold, within the sketch's error, get an exact distinct count. A line at or over the threshold is boilerplate: it
stays at its first place (least id, then position) and goes everywhere else. Lines of fewer than min_words words have a
threshold of their own, short_sites, as many of them are ordinary; without one they are left alone.

The index of lines holds hashes, not texts, and is written once. Marks are kept by row, told by the id and a hash of the text,
so rows that repeat an id with another text are judged by what they hold. Defined results: ids are whole numbers; null and
empty texts have no lines; a null site counts as none; a null id comes before all others; rows that repeat an id and a text
have the same lines removed; an empty table gives no rows; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscan.llm.common import SPACE_CHARS, SPACE_RE, own_prefix, row_key, written

MIN_SITES = 6
#: Sites from which on a line of fewer than MIN_WORDS words is boilerplate: twice those of longer lines.
SHORT_SITES = 2 * MIN_SITES
MIN_WORDS = 5
SKETCH_LG_K = 12
#: Standard errors of a sketch within which a line is counted exactly.
NEAR_ERRORS = 4
#: So many lines to count exactly are broadcast at most; beyond that the rows of one line are dealt over SALTS places to be joined.
BROADCAST_LINES = 100_000
SALTS = 32
ADDED = ["n_lines", "n_removed", "kept_text"]


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_words: int = MIN_WORDS, with_short: bool = False) -> DataFrame:
    """(key, row, site, pos, h, short) of each line that can be boilerplate: those of min_words words, or with_short every one with a word."""
    rows = docs.select(*row_key(id_col, text_col), F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    lines = rows.select("key", "row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    trimmed = lines.select("key", "row", "site", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
    enough = F.size(F.split("line", SPACE_RE)) >= min_words
    wanted = F.col("line") != "" if with_short else enough
    return trimmed.filter(wanted).select("key", "row", "site", "pos", F.xxhash64("line", F.char_length("line")).alias("h"), (~enough).alias("short"))


def _band(sites: int, lg_k: int) -> int:
    """Sites by which an estimate near a threshold can be off."""
    return max(1, math.ceil(NEAR_ERRORS * 1.04 / math.sqrt(1 << lg_k) * sites))


def boilerplate(index: DataFrame, min_sites: int = MIN_SITES, short_sites: int | None = None, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """(h, first struct<key,pos>) of the lines that at least min_sites sites share; short_sites for short lines."""
    short_sites = min_sites if short_sites is None else short_sites
    pick = lambda long, short: F.when(F.col("short"), F.lit(short)).otherwise(F.lit(long))
    sketch = F.hll_sketch_agg("site", F.lit(lg_k))
    sums = index.groupBy("h").agg(F.max("short").alias("short"), F.min(F.struct("key", "pos")).alias("first"), F.hll_sketch_estimate(sketch).alias("estimate"))
    limit, band = pick(min_sites, short_sites), pick(_band(min_sites, lg_k), _band(short_sites, lg_k))
    # what is far below its threshold goes before it is written
    some = written(sums.select("h", "first", "estimate", limit.alias("limit"), band.alias("band")).filter(F.col("estimate") >= F.col("limit") - F.col("band")))
    clear = some.filter(F.col("estimate") > F.col("limit") + F.col("band")).select("h", "first")
    near = some.filter(F.col("estimate") <= F.col("limit") + F.col("band"))
    if near.count() <= BROADCAST_LINES:
        places = index.filter("site is not null").join(F.broadcast(near.select("h")), "h")
    else:  # a line that a third of all rows hold lies in as many places as there are salts, until its sites are combined
        salts = near.select("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        salted = index.filter("site is not null").select("h", "site", F.pmod(F.xxhash64("key", "row", "pos"), F.lit(SALTS)).alias("salt"))
        places = salted.join(salts.hint("merge"), ["h", "salt"])
    exact = places.select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return clear.union(near.join(exact, "h").filter(F.col("n") >= F.col("limit")).select("h", "first"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, short_sites: int | None = None) -> DataFrame:
    """The columns of docs with n_lines (lines with a word), n_removed and kept_text (null text: empty)."""
    docs = docs.drop(*[c for c in ADDED if c not in (text_col, id_col, site_col)])
    index = written(line_index(docs, id_col, text_col, site_col, min_words, short_sites is not None))
    common = written(boilerplate(index, min_sites, short_sites))
    gone = index.join(common, "h").filter((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
    k, r, drop_col = (own_prefix(docs) + x for x in ("key", "row", "gone"))
    marks = gone.groupBy(F.col("key").alias(k), F.col("row").alias(r)).agg(F.collect_set("pos").alias(drop_col))
    key, row = row_key(id_col, text_col)
    joined = docs.select("*", key.alias(k), row.alias(r)).join(marks, [k, r], "left").drop(k, r)
    # each select names what the next one refers to more than once; positions that stay are found through a hash set
    lines, text = own_prefix(docs) + "lines", F.coalesce(F.col(text_col), F.lit(""))
    split = joined.withColumn(lines, F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop_col))
    kept = F.when(F.col(drop_col).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    full = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")).cast("bigint")
    gone_here = F.coalesce(F.array_size(drop_col), F.lit(0)).cast("bigint")
    return split.select(*docs.columns, full.alias("n_lines"), gone_here.alias("n_removed"), kept.alias("kept_text"))
