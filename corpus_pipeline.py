"""A corpus from documents to packed sequences, in stages that each call one operator of loomscan.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
documents, with text and n_chars as the stage leaves them; the last returns the pieces of packed sequences. Rows with null
texts are rejected by the first stage; rows that repeat an id with another text are documents of their own, exact copies of a
row go with near-duplicate removal; columns beside those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.llm import line_dedup, near_copies, packing, quality_rules, substring_dedup
from loomscan.llm.common import SPACE_CHARS, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(rows: DataFrame, text: Column) -> DataFrame:
    new = rows.withColumns({"__text": text}).withColumns({"text": F.col("__text"), "n_chars": F.char_length("__text").cast("bigint")})
    return new.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much."""
    return _documents(quality_rules.judge(docs.select(*COLUMNS)).filter("kept"), F.col("kept_text"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sites share stay at their first place; documents of which nothing is left go."""
    found = line_dedup.remove_boilerplate(docs.select(*COLUMNS), short_sites=line_dedup.SHORT_SITES)
    return _documents(found.filter(F.btrim("kept_text", F.lit(SPACE_CHARS)) != ""), F.col("kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash of five-word shingles in covering tables, then a Jaccard similarity of 0.8 or more."""
    return near_copies.one_of_each(docs.select(*COLUMNS))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start earlier elsewhere go; documents of which nothing is left go."""
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    return _documents(found.filter(F.btrim("kept_text", F.lit(SPACE_CHARS)) != ""), F.col("kept_text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    found = packing.pack(docs)
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("substring_dedup", substrings), ("packing", packed)]

#: Fingerprints and tokens can't be had in SQL: a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
