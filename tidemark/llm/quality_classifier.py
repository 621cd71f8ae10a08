"""Quality classifier: a sparse ensemble of tree rules over document statistics.

Small boosted trees are grown on labelled documents; every path from a root is
a conjunctive rule over the statistics; a logistic model with an L1 penalty
weighs the rules, most of them with 0; the rest become one Spark column
expression over the statistics.

The fit uses at most ``MAX_TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id; everything else covers all rows.

Defined results: null and empty texts have statistics of 0 and get a score as
any other; rows with a repeated id are scored row by row; a null id is never
held out, carried as null and never learnt from; labels that are null don't
count; without labels of both kinds the score is the smoothed share of label 1;
an empty table gives an empty result.  Only id and text are read, and other
columns are carried; names that begin with ``_td_`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import block_counts
from .staging import bound_batches, read_table
from .textblock import blocks, per_text, repeated

MAX_TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, MIN_LEAF, SHRINK = 24, 3, 32, 20, 0.4
L1, STEPS = 1e-3, 400

STATS = ("log_words", "word_chars", "symbols", "dup_lines", "repeats", "upper", "digits", "stops", "exclaims", "bars", "distinct", "non_ascii", "line_words", "short_words")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT, _STOP, _EXCLAIM, _BAR = _class(b"0123456789"), _class(b".,;:?"), _class(b"!"), _class(b"|")
_HIGH = np.arange(256) >= 0x80


def block_stats(t) -> list[np.ndarray]:
    c = {k: v.astype(float) for k, v in block_counts(t).items()}
    share = lambda a, b: a / np.maximum(b, 1.0)
    of = lambda table: per_text(t.offs, table[t.buf]).astype(float)
    _, first = repeated(t.word_hashes(fold=True), t.text_of_word())
    size = np.diff(t.offs).astype(float)
    return [
        np.log1p(c["n_words"]), share(c["word_chars"], c["n_words"]), share(c["n_symbols"], c["word_chars"]), share(c["n_dup_lines"], c["n_lines"]),
        share(c["n_repeat_words"], c["n_words"]), share(of(_UPPER), of(_LETTER)), share(of(_DIGIT), size), share(of(_STOP), c["n_words"]),
        share(of(_EXCLAIM), c["n_words"]), share(of(_BAR), c["n_words"]), share(per_text(t.woff, first).astype(float), c["n_words"]), share(of(_HIGH), size),
        share(c["n_words"], c["n_lines"]), share(per_text(t.woff, (t.ends - t.starts) <= 3).astype(float), c["n_words"]),
    ]


def statistics(rows: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``rows`` with the statistics in columns ``_td_*`` after its own, of which the text goes unless it is to stay."""
    bound_batches(rows.sparkSession)
    rest = [c for c in rows.columns if keep_text or c != text_col]
    names = [*rest, *(f"_td_{s}" for s in STATS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, t in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *(pa.array(x, pa.float64()) for x in block_stats(t))], names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"_td_{s} double" for s in STATS]))


Condition = tuple[int, bool, float]  # statistic, whether it must be over the threshold, threshold


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self) -> F.Column:
        """The score as a column over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for stat, over, at in rule:
                c = F.col(f"_td_{STATS[stat]}")
                holds = holds & ((c > at) if over else (c <= at))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray) -> None:
    """One tree by second-order gain; adds the paths to ``out`` and each row's leaf value to ``step``."""
    if path:
        out.append(path)
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * MIN_LEAF:
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            a, c = np.cumsum(np.bincount(b, g[rows], BINS))[:-1], np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
            gain = a * a / (c + 1) + (gs - a) ** 2 / (hs - c + 1) - gs * gs / (hs + 1)
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = -1
            if (k := int(gain.argmax()), float(gain.max()))[1] > best[0]:
                best = (float(gain.max()), f, k)
    if best[1] is None:
        step[rows] = -gs / (hs + 1)
        return
    _, f, k = best
    over = bins[rows, f] > k
    _grow(bins, g, h, rows[~over], depth - 1, (*path, (f, False, k)), out, step)
    _grow(bins, g, h, rows[over], depth - 1, (*path, (f, True, k)), out, step)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """The rule ensemble for statistics ``x`` and labels 0 or 1."""
    n1 = int((y == 1).sum())
    base = math.log((n1 + 1) / (len(y) - n1 + 1))
    if not 0 < n1 < len(y):
        return RuleModel((), (), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    z, paths = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        _grow(bins, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), paths, step)
        z += SHRINK * step
    seen: dict[bytes, tuple] = {}
    for path in paths:
        holds = np.ones(len(y), bool)
        for f, over, k in path:
            holds &= (bins[:, f] > k) == over
        if 0 < holds.sum() < len(y):
            seen.setdefault(holds.tobytes(), (path, holds))
    rules = [tuple((f, over, float(edges[f][k])) for f, over, k in path) for path, _ in seen.values()]
    a = np.stack([holds for _, holds in seen.values()], 1).astype(np.float32) if seen else np.zeros((len(y), 0), np.float32)
    w, b = _lasso(a, y.astype(np.float32), base)
    used = np.flatnonzero(w)
    return RuleModel(tuple(rules[i] for i in used), tuple(float(w[i]) for i in used), float(b))


def _lasso(a: np.ndarray, y: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n = len(y)
    v = np.ones(a.shape[1], np.float32)
    for _ in range(20):
        v = a.T @ (a @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 4.0 / (top / n + 1.0)
    w = u = np.zeros(a.shape[1], np.float32)
    c, t = b, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(a @ u + c))) - y
        new = u - rate * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
        nb = c - rate * float(r.mean())
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        u, c = new + (old - 1) / t * (new - w), nb + (old - 1) / t * (nb - b)
        w, b = new, nb
    return w, b


def held_out(id_col: str | F.Column, parts: int, rest: int) -> F.Column:
    """Whether the row belongs to the fold that nothing is learnt from; null ids don't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, parts: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled documents with at most ``most`` ids: _td_id, _td_label, _td_hash (of the text) and text; as many rows of labels are broadcast.

    What is made of the texts goes through ``one_each`` before it is collected.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, parts, rest))
    rows = rows.select(F.col(id_col).cast("long").alias("_td_id"), F.col(label_col).cast("int").alias("_td_label")).orderBy(F.xxhash64("_td_id"), "_td_id", "_td_label").limit(most)
    found = docs.select(F.col(id_col).cast("long").alias("_td_id"), F.xxhash64(text_col).alias("_td_hash"), F.col(text_col).alias("text"))
    return found.join(F.broadcast(rows.distinct()), "_td_id").select("_td_id", "_td_label", "_td_hash", "text")


def one_each(sample: DataFrame, *columns: str) -> DataFrame:
    """_td_label and the columns, once for each id and label: of documents that share an id, the text with the smallest hash counts."""
    return sample.groupBy("_td_id", "_td_label").agg(F.min_by(F.struct(*columns), "_td_hash").alias("_td_one")).select("_td_label", "_td_one.*")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 3, rest: int = 1, most: int = MAX_TRAIN_ROWS) -> RuleModel:
    got = one_each(statistics(training_sample(docs, labels, label_col, parts, rest, most)), *(f"_td_{s}" for s in STATS)).toPandas()
    got = got.sort_values(list(got.columns))
    return fit(got.iloc[:, 1:].to_numpy(float), got["_td_label"].to_numpy())


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return statistics(rows).select("doc_id", model.column().alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The documents that score ``at_least`` that, with all their columns."""
    return statistics(docs, text_col, keep_text=True).where(model.column() >= at_least).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
