"""Site-relative line frequency: lines on too large a share of a host's pages are boilerplate.

A page counts once for a line however often it has it.  A line is dropped from
all pages of a host if more than ``MIN_PAGES`` pages of the host have it and
they are more than ``MAX_RATIO`` of the host's pages.

Lines are compared by 64-bit hashes: with n different lines of a host, the chance
that two of them are taken for one is about n * n / 2**65.

A host has at most (mean lines of its pages / MAX_RATIO) such lines, so its
list is bounded for any number of pages.  The lists go to the documents by
broadcast while all of them together are small, and by a salted join beyond.

Defined results: lines without a word are no lines and always stay; a null text
stays null; documents without a host form no site and keep their lines; an
emptied document stays as an empty text; repeated rows count as pages of their
own; an empty table stays empty.  Column names that begin with ``_td_`` are
reserved, no other name clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import materialize, read_table

MAX_RATIO = 0.2
#: Pages that may share a line on any host, however small: on three pages and more it is the ratio that counts.
MIN_PAGES = 2
#: All hosts' lines are broadcast up to so many.
BROADCAST_LINES = 200_000
SALTS = 64

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: F.Column) -> F.Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line hash and page counts of the lines to drop."""
    pages = docs.where(F.col(host_col).isNotNull()).select(F.col(host_col).cast("string").alias("_td_host"), F.col(text_col).alias("_td_text"))
    totals = pages.groupBy("_td_host").agg(F.count(F.lit(1)).alias("_td_total"))
    line = pages.select("_td_host", F.explode(F.array_distinct(_lines("_td_text"))).alias("_td_line")).where(F.col("_td_line").rlike(_HAS_WORD))
    counts = line.groupBy("_td_host", F.xxhash64("_td_line").alias("_td_hash")).agg(F.count(F.lit(1)).alias("_td_pages")).where(F.col("_td_pages") > min_pages)
    return counts.join(totals, "_td_host").where(F.col("_td_pages") > max_ratio * F.col("_td_total"))


def drop_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the cleaned text in ``_td_kept`` and the number of dropped lines in ``_td_dropped``."""
    found = materialize(boilerplate(docs, text_col, host_col, max_ratio, min_pages), "boilerplate")
    lists = found.groupBy("_td_host").agg(F.collect_set("_td_hash").alias("_td_bad"))
    if found.count() <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(lists), docs[host_col].cast("string") == lists["_td_host"], "left")
    else:
        salted = lists.withColumn("_td_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = docs.withColumn("_td_own", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, (own[host_col].cast("string") == salted["_td_host"]) & (own["_td_own"] == salted["_td_salt"]), "left").drop("_td_own", "_td_salt")
    lines = _lines(F.col(text_col))
    kept = F.filter(lines, lambda x: ~(F.array_contains("_td_bad", F.xxhash64(x)) & x.rlike(_HAS_WORD)))
    has = F.col("_td_bad").isNotNull() & F.col(text_col).isNotNull()
    return joined.withColumn("_td_lines", F.when(has, kept)).select(
        *(docs[f"`{c}`"] for c in docs.columns),
        F.when(has, F.array_join("_td_lines", "\n")).otherwise(F.col(text_col)).alias("_td_kept"),
        F.when(has, F.size(lines) - F.size("_td_lines")).otherwise(0).cast("long").alias("_td_dropped"),
    )


def line_dedup(docs: DataFrame, text_col: str = "text", host_col: str = "source", chars_col: str | None = None, **limits) -> DataFrame:
    """``docs`` with cleaned texts; ``chars_col``, if given, is counted again where lines went."""
    cleaned = drop_lines(docs, text_col, host_col, **limits)
    new = {text_col: F.col("_td_kept")}
    if chars_col:
        new[chars_col] = F.when(F.col("_td_dropped") > 0, F.length("_td_kept").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return cleaned.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_lines(docs).select("doc_id", F.col("_td_dropped").alias("n_dropped"), F.sha2(F.coalesce("_td_kept", F.lit("")), 256).alias("kept_sha256"))


def oracle(table: str = "documents") -> str:
    """SQL: doc_id, the kept text and the number of dropped lines of each document."""
    return rf"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM {table}),
t AS (SELECT source, count(*) AS total FROM {table} WHERE source IS NOT NULL GROUP BY source),
p AS (
  SELECT source, line, count(*) AS pages
  FROM (SELECT DISTINCT doc_id, source, line FROM l WHERE source IS NOT NULL AND regexp_matches(line, '{_HAS_WORD}'))
  GROUP BY source, line),
bad AS (SELECT source, line, true AS bad FROM p JOIN t USING (source) WHERE pages > {MIN_PAGES} AND pages > {MAX_RATIO} * total),
k AS (
  SELECT doc_id, string_agg(CASE WHEN bad IS NULL THEN line END, chr(10) ORDER BY i) AS kept, count(bad) AS n_dropped
  FROM l LEFT JOIN bad USING (source, line) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS kept, coalesce(n_dropped, 0) AS n_dropped
FROM {table} d LEFT JOIN k USING (doc_id)"""


ORACLE_SQL = f"SELECT doc_id, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM ({oracle()})"
