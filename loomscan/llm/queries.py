"""The registered queries opN_<name>, each over the whole of its tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import html_text, line_dedup, neighbours, packing, quality_classifier, quality_rules, sentence_pieces, simhash, substring_dedup, token_counts
from loomscan.llm.common import table, words


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document before and after its redactions, with how much was counted anew."""
    found = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pieces", "n_recounted", F.md5(F.col("edited_text").cast("binary")).alias("edited_md5"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "settled")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("kept_text")), " ").cast("binary"), 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), short_sites=line_dedup.SHORT_SITES)
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("kept_text").cast("binary")).alias("kept_md5"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of each document, with a digest of what they decode to."""
    found = sentence_pieces.encode(table(spark, sf_dir, "documents"), decoded=True)
    return found.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_packing, op3_quality_classifier, op4_substring_dedup, op5_html_text, op6_neighbours, op7_line_dedup, op8_quality_rules, op9_simhash, op10_sentence_pieces)}

_WORDS = "regexp_split_to_array(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t-\\r]+')"

ORACLE_SQL = {
    "op4_substring_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
v AS (SELECT rid, doc_id, i, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY g) AS fd, min(struct_pack(a := doc_id, b := i)) OVER (PARTITION BY g) AS fs FROM v),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM f WHERE fs.a <> doc_id OR fs.b <> i),
p AS (SELECT rid, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.rid, count(c.p) AS n_removed, string_agg(p.x, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept FROM p LEFT JOIN c ON p.rid = c.rid AND p.p = c.p GROUP BY p.rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.rid = k.rid
""",
    "op7_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT rid, doc_id, source, unnest(l) AS x, unnest(range(len(l))) AS pos FROM d),
n AS (SELECT *, list_filter(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t-\r]+'), lambda y: y <> '') AS w, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM e),
b AS (SELECT t, min(struct_pack(a := doc_id, b := pos)) AS f FROM n WHERE len(w) > 0 GROUP BY t HAVING count(DISTINCT source) >= CASE WHEN any_value(len(w)) < {line_dedup.MIN_WORDS} THEN {line_dedup.SHORT_SITES} ELSE {line_dedup.MIN_SITES} END),
m AS (SELECT n.rid, n.pos, n.x, len(n.w) AS k, b.t IS NOT NULL AND (b.f.a <> n.doc_id OR b.f.b <> n.pos) AS gone FROM n LEFT JOIN b ON n.t = b.t),
s AS (SELECT rid, sum(CAST(k > 0 AS BIGINT)) AS n_lines, sum(CAST(gone AS BIGINT)) AS n_removed, string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, md5(coalesce(kept, '')) AS kept_md5 FROM d LEFT JOIN s ON d.rid = s.rid
""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, list_filter({_WORDS}, lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, x, {{count}} AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT rid, x, n, len(regexp_replace(x, '[ \t-\r]+', '', 'g')) AS chars, n > 0 AND (
  len(x) - len(regexp_replace(x, '{quality_rules.SYMBOL_CLASS}', '', 'g')) > {quality_rules.SYMBOLS_PER_WORD} * n
  OR (len(x) - len(regexp_replace(x, '{quality_rules.SHOUT_CLASS}', '', 'g')) > {quality_rules.SHOUTS_PER_WORD} * n AND n >= 3)
  OR (n >= {quality_rules.UNPUNCTUATED_WORDS} AND NOT regexp_matches(x, '{quality_rules.MARK_CLASS}'))
  OR len(x) - len(regexp_replace(x, '{quality_rules.SEPARATOR_CLASS}', '', 'g')) > {quality_rules.SEPARATORS_PER_WORD} * n
  OR regexp_matches(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{quality_rules.NAVIGATION}')
  OR regexp_matches(x, '{quality_rules.BOILERPLATE}')) AS fails FROM l),
s AS (SELECT rid, sum(CAST(n > 0 AS BIGINT)) - count(DISTINCT x) FILTER (WHERE n > 0) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost_chars FROM f GROUP BY rid),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(regexp_replace(t, '{quality_rules.SYMBOL_CLASS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(s.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(s.lost_chars AS BIGINT) AS lost_chars FROM d LEFT JOIN r ON d.rid = r.rid LEFT JOIN s ON d.rid = s.rid)
SELECT *, base_failed = false AND lost_chars <= {quality_rules.MAX_LOST} * word_chars AS kept FROM (SELECT *, n_words < {quality_rules.MIN_WORDS} OR n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM a)
""".replace("{{count}}", "len(list_filter(regexp_split_to_array(x, '[ \\t-\\r]+'), lambda y: y <> ''))").replace("{count}", "len(list_filter(regexp_split_to_array(x, '[ \\t-\\r]+'), lambda y: y <> ''))"),
}
