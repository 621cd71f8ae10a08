"""Document quality rules and verdicts on whole hosts.

Every rule is counted per document, failures are summed per host, each host's
failure rate is shrunk towards a beta prior that is fitted to all hosts by the
method of moments (the variance of the rates, less what a host's few documents add
to it by chance, is the variance between hosts), and hosts whose shrunk rate passes a limit are rejected with
all their documents.

Defined results: a null or empty text has no words and fails the word rule; a
null host belongs to no host and gets no host verdict; rows with a repeated id
are judged row by row; a null id is kept as null; an empty table gives an empty
result.  Columns besides id, text and host are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import bound_batches, materialize, read_table
from .textblock import blocks, per_text, repeated

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINES_PERCENT = 30
HOST_LIMIT = 0.5
#: A host table of no more rows than this is broadcast.
BROADCAST_HOSTS = 100_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
RULES = ("few_words", "repeats", "symbols", "dup_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def block_counts(t) -> dict[str, np.ndarray]:
    """The counts of one block of texts, an array of longs each."""
    words = t.word_hashes()
    windows, at = t.windows(3, words)
    twice, _ = repeated(windows, np.searchsorted(t.woff, at, side="right") - 1)
    inside = np.zeros(len(words) + 1, np.int64)
    hit = at[twice]
    np.add.at(inside, hit, 1)
    ends = hit + 3
    np.add.at(inside, ends, -1)
    starts, stops, texts = t.lines()
    has_word = np.searchsorted(t.starts, stops) > np.searchsorted(t.starts, starts)
    starts, stops, texts = starts[has_word], stops[has_word], texts[has_word]
    _, first = repeated(t.span_hash(starts, stops), texts)
    lead = t.in_word & ((t.buf & 0xC0) != 0x80)
    return {
        "n_words": t.n_words,
        "word_chars": per_text(t.offs, lead),
        "n_symbols": per_text(t.offs, _SYMBOL[t.buf]),
        "n_dup_lines": np.bincount(texts[~first], minlength=t.n),
        "n_repeat_words": per_text(t.woff, np.cumsum(inside[:-1]) > 0),
        "n_lines": np.bincount(texts, minlength=t.n),
    }


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host and the rule counts of every document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "host", *_COUNTS]
        for rows, t in blocks(batches, "text"):
            found = block_counts(t)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(found[c].astype(np.int64)) for c in _COUNTS)], names)

    return rows.mapInArrow(count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))


def rule_failures() -> dict[str, F.Column]:
    c = F.col
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > MAX_DUP_LINES_PERCENT * c("n_lines"),
    }


def beta_prior(mean: float, variance: float, chance: float = 0.0) -> tuple[float, float]:
    """Beta parameters of hosts whose rates have this mean and variance; strength is held between 1 and 10**6.

    ``chance``: the mean over hosts of 1 / documents, the share of the variance
    of single documents that a host's rate has by chance.
    """
    if not 0 < mean < 1:
        return (0.5, 0.5)
    between = variance / (mean * (1 - mean)) - chance
    strength = min(max((1 - chance) / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return mean * strength, (1 - mean) * strength


def host_verdicts(counts: DataFrame, limit: float = HOST_LIMIT) -> tuple[DataFrame, int]:
    """Per host: documents, failures and shrunk failure rate of each rule, host_ok; and how many hosts there are.

    The prior's moments are one row for any number of hosts.
    """
    fails = rule_failures()
    hosts = counts.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.when(fails[r], 1).otherwise(0)).alias(f"f_{r}") for r in RULES))
    hosts = materialize(hosts, "hosts")
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    moments = hosts.agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("n_docs")).alias("chance"), *(F.avg(rate[r]).alias(f"m_{r}") for r in RULES), *(F.var_samp(rate[r]).alias(f"v_{r}") for r in RULES)).first()
    ok = F.lit(True)
    for r in RULES:
        a, b = beta_prior(moments[f"m_{r}"] or 0.0, moments[f"v_{r}"] or 0.0, moments["chance"] or 0.0)
        hosts = hosts.withColumn(f"rate_{r}", (F.col(f"f_{r}") + a) / (F.col("n_docs") + a + b))
        ok = ok & (F.col(f"rate_{r}") <= limit)
    return hosts.withColumn("host_ok", ok), moments["n"]


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT, **columns: str) -> DataFrame:
    """Counts, base_failed and kept of every document."""
    counts = materialize(document_counts(docs, **columns), "rule-counts")
    hosts, n = host_verdicts(counts, limit)
    verdicts = hosts.select("host", "host_ok")
    joined = counts.join(F.broadcast(verdicts) if n <= BROADCAST_HOSTS else verdicts, "host", "left")
    fails = rule_failures()
    failed = fails["few_words"] | fails["repeats"]
    return joined.select("doc_id", *_COUNTS, failed.alias("base_failed"), (~failed & F.coalesce("host_ok", F.lit(True))).alias("kept"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents")).drop("n_lines")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1)
  GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (
  SELECT *, n_words < {MIN_WORDS} AS r1, 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS r2,
         100 * n_symbols > {MAX_SYMBOL_PERCENT} * word_chars AS r3, 100 * n_dup_lines > {MAX_DUP_LINES_PERCENT} * n_lines AS r4
  FROM c),
h AS (
  SELECT source, rule, count(*) AS n, sum(fail::int) AS f
  FROM (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest([r1, r2, r3, r4]) AS fail FROM f WHERE source IS NOT NULL)
  GROUP BY source, rule),
m AS (SELECT rule, avg(f / n) AS mean, avg(1 / n) AS chance, coalesce(var_samp(f / n), 0) AS var FROM h GROUP BY rule),
b AS (SELECT *, CASE WHEN mean > 0 AND mean < 1 THEN var / (mean * (1 - mean)) - chance END AS between_hosts FROM m),
s AS (
  SELECT rule, mean, CASE WHEN between_hosts IS NULL THEN 1 WHEN between_hosts > 0 THEN least(greatest((1 - chance) / between_hosts - 1, 1.0), 1e6) ELSE 1e6 END AS k,
         CASE WHEN between_hosts IS NULL THEN 0.5 ELSE mean END AS p
  FROM b),
v AS (SELECT source, bool_and((f + p * k) / (n + k) <= {HOST_LIMIT}) AS host_ok FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
       n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words,
       r1 OR r2 AS base_failed, NOT (r1 OR r2) AND coalesce(host_ok, true) AS kept
FROM f LEFT JOIN v USING (source)
"""
