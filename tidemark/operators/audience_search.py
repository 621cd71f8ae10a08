"""Audience search by vector: exact, by an index of cells, or both, as the size of the corpus asks for."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, is_valid
from .ranking import salted_sample
from .vector_search import CONFIDENCE, EXACT_LIMIT, TARGET_RECALL, TRANSITION_LIMIT, Z, nearest_segments, scored


@dataclass(frozen=True)
class Policy:
    """Up to ``exact`` vectors the search is exact, up to ``transition`` an index runs beside it, and only beyond that alone."""

    exact: int = EXACT_LIMIT
    transition: int = TRANSITION_LIMIT
    least: int = 10_000
    safety: float = 1.5
    most_share: float = 0.25
    least_audit: int = 10_000
    most_audit: int = 50_000
    target: float = TARGET_RECALL


@dataclass(frozen=True)
class Audit:
    retrieved: int
    audited: int
    missed: int
    estimated_recall: float
    lower_bound: float
    confidence: float
    accepted: bool


@dataclass(frozen=True)
class Search:
    """``members``: key and score of everyone found; ``requested``: how many candidates were asked for."""

    method: str
    members: DataFrame
    requested: int
    audit: Audit | None


def _recall(found: int, lost: float) -> float:
    return found / (found + lost) if found + lost > 0 else 1.0


def sampled_audit(found: int, audited: int, missed: int, unseen: int, target: float = TARGET_RECALL) -> Audit:
    """Recall where ``missed`` of ``audited`` vectors, drawn from ``unseen`` ones, should have been found; its lower bound by Wilson's interval."""
    if audited == 0:
        rate = upper = 1.0
    else:
        rate = missed / audited
        spread = Z * math.sqrt(rate * (1 - rate) / audited + Z * Z / (4 * audited * audited))
        upper = min((rate + Z * Z / (2 * audited) + spread) / (1 + Z * Z / audited), 1.0)
    bound = _recall(found, upper * unseen)
    return Audit(found, audited, missed, _recall(found, rate * unseen), bound, CONFIDENCE, bound >= target)


class CellIndex:
    """Vectors in files by cell; a search reads the cells whose centres are nearest to the query.

    Centres are fitted on the driver to at most ``sample`` valid vectors (those of
    smallest salted hash); every vector is indexed.  Large cells are cut into
    several files, small ones aren't spread over the tasks.  Candidates are whole
    cells, so no sort or limit is needed, and what wasn't read is known by cell.
    """

    def __init__(self, rows: DataFrame, centres: np.ndarray, sizes: dict[int, int], key: str, column: str):
        self.rows, self.centres, self.sizes, self.key, self.column = rows, centres, sizes, key, column

    @property
    def size(self) -> int:
        return sum(self.sizes.values())

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str, column: str = "embedding", cells: int = 64, sample: int = 20_000, rounds: int = 8) -> CellIndex:
        spark = vectors.sparkSession
        rows = vectors.select(key, column)
        first = rows.where(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
        dim = first["n"] if first else 1
        valid = rows.where(is_valid(F.col(column), dim))
        picked = salted_sample(valid, key, "cells", sample, valid.count()).select(doubles(F.col(column)))
        v = np.array([r[0] for r in picked.collect()], float).reshape(-1, dim)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        centres = np.unique(v[:cells], axis=0) if len(v) else np.eye(1, dim)
        for _ in range(rounds if len(v) else 0):
            own = (v @ centres.T).argmax(1)
            for c in np.unique(own):
                mean = v[own == c].mean(0)
                size = np.linalg.norm(mean)
                if size > 0:
                    centres[c] = mean / size
        named = spark.createDataFrame([(f"{i:06d}", c.tolist()) for i, c in enumerate(centres)], "segment_id string, centroid array<double>")
        placed = nearest_segments(rows, named, 1, column=column).withColumn("cell", F.col("nearest")[0]["id"].cast("int")).drop("nearest")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed.repartitionByRange(n, "cell", F.xxhash64(key)).write.mode("overwrite").partitionBy("cell").parquet(path)
        stored = spark.read.schema(placed.schema).parquet(path)
        sizes = {r["cell"]: r["count"] for r in stored.groupBy("cell").count().collect()}
        return cls(stored, centres, sizes, key, column)

    def cells(self, query, k: int) -> list[int]:
        """The nearest cells that hold at least k vectors together."""
        order = np.argsort(-(self.centres @ np.asarray(query, float)), kind="stable")
        chosen, held = [], 0
        for c in order.tolist():
            if held >= k:
                break
            if c in self.sizes:
                chosen.append(c)
                held += self.sizes[c]
        return chosen


def _members(index: CellIndex, rows: DataFrame, query, threshold: float, matching: DataFrame | None) -> DataFrame:
    found = scored(rows, query, index.column).where(F.col("score") >= threshold).select(index.key, "score")
    return found if matching is None else found.join(matching.select(index.key), index.key, "left_semi")


def search(index: CellIndex, query, threshold: float, matching: DataFrame | None = None, expected: float = 0.0, policy: Policy | None = None) -> Search:
    """Everyone among ``matching`` (all without it) whose vector reaches the threshold.

    ``expected``: how many that should be, by an estimate.  The index is asked for
    ``safety`` times as many candidates, ``least`` at least, and twice as many as
    long as the audit of what it hasn't read fails and a quarter of the corpus
    isn't passed; then the search is exact after all.
    """
    policy = policy or Policy()
    n = index.size
    asked = min(n, max(policy.least, math.ceil(policy.safety * expected)))
    exact = _members(index, index.rows, query, threshold, matching)
    if n <= policy.exact:
        return Search("exact", exact, n, None)
    if n <= policy.transition:
        shadow = _members(index, index.rows.where(F.col("cell").isin(index.cells(query, asked))), query, threshold, matching)
        hits = exact.join(shadow.select(index.key, F.lit(1).alias("_hit")), index.key, "left").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits")).first()
        found, missed = hits["hits"], hits["n"] - hits["hits"]
        recall = _recall(found, missed)
        return Search("transition", exact, asked, Audit(found, hits["n"], missed, recall, recall, 1.0, recall >= policy.target))
    most = max(policy.least, math.ceil(n * policy.most_share))
    tries = min(policy.most_audit, max(policy.least_audit, math.ceil(n * 0.01)))
    while asked <= most and asked < n:
        cells = index.cells(query, asked)
        members = _members(index, index.rows.where(F.col("cell").isin(cells)), query, threshold, matching)
        unseen = n - sum(index.sizes[c] for c in cells)
        drawn = salted_sample(index.rows.where(~F.col("cell").isin(cells)), index.key, "audit", tries, unseen)
        missed = _members(index, drawn, query, threshold, matching).count()
        audit = sampled_audit(members.count(), min(tries, unseen), missed, unseen, policy.target)
        if audit.accepted:
            return Search("index", members, asked, audit)
        asked = min(n, asked * 2)
    return Search("exact_fallback", exact, n, None)
