"""Toxicity: a factorization machine over hashed terms.

Terms are maximal runs of ASCII letters, digits and bytes over 0x7F, with A-Z
folded, hashed to 2**20 buckets.  A document is the set of its buckets.  The
machine adds to the linear weights an interaction of each pair of terms,
factored in ``FACTORS`` dimensions.

A term's value is its weight of evidence on the training rows, the clipped
square of its two-proportion z score, so that terms that are spread alike over
both labels hardly speak and a few noisy labels aren't learnt by heart.

The fit uses at most ``MAX_TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id, and only buckets that ``MIN_SHARE`` of them have, ``MIN_DOCS``
rows at least; scoring covers every term of every whole text.

Defined results: null and empty texts get the score of no terms; rows with a
repeated id are scored row by row; a null id is never held out, carried as null
and never learnt from; null labels don't count; without labels of both kinds
the score is the smoothed share of label 1; an empty table gives an empty
result.  Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_classifier import held_out, one_each, training_sample
from .staging import bound_batches, read_table
from .textblock import U, blocks, repeated

MAX_TRAIN_ROWS = 12_000
BUCKET_BITS = 20
MIN_DOCS, MIN_SHARE = 3, 0.001
FACTORS = 8
#: The z score at which a term has its full value, and the least value of any.
FULL_SCORE, LEAST_VALUE = 6.0, 0.01
EPOCHS, BATCH, RATE, L2, L2_FACTORS = 8, 128, 0.1, 2e-3, 2e-2
#: Small training sets get more epochs, for so many steps.
MIN_STEPS = 600

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def block_terms(t) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text, end to end, and their offsets."""
    bucket = (t.word_hashes(fold=True) >> U(64 - BUCKET_BITS)).astype(np.int32)
    _, first = repeated(bucket.astype(U), t.text_of_word())
    at = np.flatnonzero(first)
    return bucket[at], np.searchsorted(at, t.woff)


@dataclass(frozen=True)
class Machine:
    buckets: np.ndarray  # sorted
    linear: np.ndarray
    factors: np.ndarray
    intercept: float

    def margin(self, bucket: np.ndarray, offs: np.ndarray) -> np.ndarray:
        place = self.lookup()[bucket]
        known = place >= 0
        place = place[known]
        bounds = np.concatenate([[0], np.cumsum(known)])[offs]
        return self.intercept + _forward(self.linear, self.factors, place, bounds)[0]

    def lookup(self) -> np.ndarray:
        found = self.__dict__.get("_lookup")
        if found is None:
            found = np.full(1 << BUCKET_BITS, -1, np.int32)
            found[self.buckets] = np.arange(len(self.buckets))
            self.__dict__["_lookup"] = found
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of rows between bounds; empty stretches give 0."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0)
    return out


def _forward(w: np.ndarray, v: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = v[place]
    total = _sums(own, bounds)
    square = _sums(np.einsum("ij,ij->i", own, own), bounds)
    return _sums(w[place], bounds) + 0.5 * (np.einsum("ij,ij->i", total, total) - square), total


def fit(texts: list[np.ndarray], y: np.ndarray) -> Machine:
    """``texts``: the distinct buckets of each training document."""
    n1 = int((y == 1).sum())
    base = math.log((n1 + 1) / (len(y) - n1 + 1))
    docs = np.bincount(np.concatenate(texts) if texts else np.zeros(0, np.int64), minlength=1 << BUCKET_BITS)
    buckets = np.flatnonzero(docs >= max(MIN_DOCS, math.ceil(MIN_SHARE * len(y))))
    if not 0 < n1 < len(y):
        buckets = buckets[:0]
    rng = np.random.Generator(np.random.PCG64(7))
    m = Machine(buckets, np.zeros(len(buckets), np.float32), rng.normal(0, 0.01, (len(buckets), FACTORS)).astype(np.float32), base)
    if not len(buckets):
        return m
    with_1 = np.bincount(np.concatenate([t for t, label in zip(texts, y, strict=True) if label == 1]), minlength=1 << BUCKET_BITS)[buckets]
    share, n0 = docs[buckets] / len(y), len(y) - n1
    score = (with_1 / n1 - (docs[buckets] - with_1) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    value = np.clip((score / FULL_SCORE) ** 2, LEAST_VALUE, 1).astype(np.float32)
    place = [p[p >= 0] for p in (m.lookup()[t] for t in texts)]
    w, v, b = m.linear, m.factors, base
    gw, gv, gb = np.full(len(w), 1e-6, np.float32), np.full(v.shape, 1e-6, np.float32), 1e-6
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            rows = order[lo : lo + BATCH]
            own = [place[i] for i in rows]
            at = np.concatenate(own)
            if not len(at):
                continue
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in own])])
            z, total = _forward(w * value, v * value[:, None], at, bounds)
            r = ((1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            each = np.repeat(np.arange(len(rows)), np.diff(bounds))
            used, inv = np.unique(at, return_inverse=True)
            dw = np.bincount(inv, r[each] * value[at], len(used)).astype(np.float32) + L2 / len(rows) * w[used]
            grad = (r[each] * value[at])[:, None] * (total[each] - v[at] * value[at, None])
            by = np.argsort(inv, kind="stable")
            dv = np.add.reduceat(grad[by], np.searchsorted(inv[by], np.arange(len(used))), axis=0) + L2_FACTORS / len(rows) * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * RATE * dv / np.sqrt(gv[used])
            gb += float(r.sum()) ** 2
            b -= RATE * float(r.sum()) / math.sqrt(gb)
    return Machine(buckets, w * value, v * value[:, None], float(b))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 5, rest: int = 0, most: int = MAX_TRAIN_ROWS) -> Machine:
    bound_batches(docs.sparkSession)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in blocks(batches, "text", word_bytes=_TERM):
            bucket, offs = block_terms(t)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array([bucket[a:b].tobytes() for a, b in zip(offs, offs[1:])], pa.binary())], ["_td_id", "_td_label", "_td_hash", "terms"])

    sample = training_sample(docs, labels, label_col, parts, rest, most).mapInArrow(terms, "_td_id long, _td_label int, _td_hash long, terms binary")
    rows = sorted((r[0], bytes(r[1])) for r in one_each(sample, "terms").collect())
    return fit([np.frombuffer(x, np.int32) for _, x in rows], np.array([y for y, _ in rows], np.float32))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, t in blocks(batches, "text", word_bytes=_TERM):
            z = machine.margin(*block_terms(t)).astype(float)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    machine = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, machine).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
