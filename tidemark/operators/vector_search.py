"""Exact vector search, matching to segments, and checks of recall."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles, is_valid, unit
from .ranking import salted_sample

#: Query and segment vectors are literals in the plan up to this number.
MOST_SEGMENTS = 256
#: Beyond it, so many are multiplied at a time.
BLOCK_SEGMENTS = 10_000
EXACT_LIMIT, TRANSITION_LIMIT = 50_000, 500_000
MATCH_THRESHOLD = 0.5


def literal(v: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def scored(vectors: DataFrame, query: Sequence[float] | Column, column: str = "embedding") -> DataFrame:
    """``vectors`` with their cosine similarity to the query in ``score``; -1 where there is none."""
    q = query if isinstance(query, Column) else literal(query)
    return vectors.withColumn("score", cosine(F.col(column), q))


def above(vectors: DataFrame, query, threshold: float, column: str = "embedding") -> DataFrame:
    return scored(vectors, query, column).where(F.col("score") >= threshold)


def top_k(vectors: DataFrame, query, k: int, key: str, column: str = "embedding") -> DataFrame:
    """The k most similar rows; each partition keeps k, so no sort of the table."""
    return scored(vectors, query, column).orderBy(F.desc("score"), key).limit(k)


def search_method(n: int) -> str:
    """exact up to 50,000 vectors, exact with a shadow index up to 500,000, an index beyond; all exact here."""
    return "exact" if n <= EXACT_LIMIT else "transition" if n <= TRANSITION_LIMIT else "index"


def centroids(vectors: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Element-wise mean of each group's vectors at length 1: group, centroid."""
    each = vectors.select(group, F.posexplode(doubles(F.col(column))).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    rows = each.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    return rows.select(group, unit(F.transform("s", lambda s: s["x"])).alias("centroid"))


def segment_list(segments: DataFrame, key: str, column: str) -> Column | None:
    """All segments as one literal of (id, vector); ``None`` if they are more than ``MOST_SEGMENTS``."""
    rows = segments.select(F.col(key).cast("string"), doubles(F.col(column))).limit(MOST_SEGMENTS + 1).collect()
    if len(rows) > MOST_SEGMENTS:
        return None
    found = F.array(*(F.struct(F.lit(r[0]).alias("id"), literal(r[1]).alias("v")) for r in sorted(rows)))
    return found if rows else found.cast("array<struct<id:string,v:array<double>>>")


def nearest_segments(users: DataFrame, segments: DataFrame, k: int, key: str = "segment_id", segment_column: str = "centroid", column: str = "embedding") -> DataFrame:
    """``users`` with their k most similar segments in ``nearest`` (id, score), best first, ties by id; no shuffle."""
    listed = segment_list(segments, key, segment_column)
    if listed is None:
        return users.withColumn("nearest", _nearest_in_blocks(segments, k, key, segment_column)(doubles(F.col(column))))
    own = F.transform(listed, lambda s: F.struct((-cosine(F.col(column), s["v"])).alias("far"), s["id"].alias("id")))
    best = F.slice(F.array_sort(own), 1, k)
    return users.withColumn("nearest", F.transform(best, lambda s: F.struct(s["id"].alias("id"), (-s["far"]).alias("score"))))


def _nearest_in_blocks(segments: DataFrame, k: int, key: str, column: str):
    """The same for any number of segments: blocks of ``BLOCK_SEGMENTS``, broadcast one by one and multiplied with a batch of users."""
    context, parts, held = segments.sparkSession.sparkContext, [], []

    def ship() -> None:
        v = np.array([r[1] for r in held], float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        parts.append(context.broadcast(([r[0] for r in held], np.divide(v, size, out=np.zeros_like(v), where=size > 0), size[:, 0] > 0)))
        held.clear()

    for r in segments.select(F.col(key).cast("string"), doubles(F.col(column))).where(F.col(column).isNotNull()).toLocalIterator():
        held.append(r)
        if len(held) == BLOCK_SEGMENTS:
            ship()
    if held:
        ship()

    @F.pandas_udf("array<struct<id:string,score:double>>")
    def nearest(users):  # noqa: ANN001, ANN202
        import pandas as pd

        best: list[list[tuple[float, str]]] = [[] for _ in users]
        for part in parts:
            ids, unit_vectors, real = part.value
            for lo in range(0, len(users), 256):
                rows = users.iloc[lo : lo + 256]
                good = [u is not None and len(u) == unit_vectors.shape[1] for u in rows]
                u = np.array([x if ok else np.zeros(unit_vectors.shape[1]) for x, ok in zip(rows, good)], float)
                size = np.linalg.norm(u, axis=1, keepdims=True)
                score = np.where((size > 0) & real, np.divide(u, size, out=np.zeros_like(u), where=size > 0) @ unit_vectors.T, -1.0)
                top = np.argpartition(-score, min(k, len(ids) - 1), axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(u), 1))
                edge = np.take_along_axis(score, top, 1).min(1) if len(ids) > k else np.full(len(u), -2.0)
                for i in range(len(u)):
                    # ties with the last of the best are decided by id
                    found = np.flatnonzero(score[i] >= edge[i])
                    best[lo + i] = sorted([*best[lo + i], *((-float(score[i, j]), ids[j]) for j in found)])[:k]
        return pd.Series([[{"id": i, "score": -s} for s, i in x] for x in best])

    return nearest


def match_segments(users: DataFrame, segments: DataFrame, dim: int, threshold: float = MATCH_THRESHOLD, fallback: str = "fallback", **names: str) -> DataFrame:
    """``users`` with segment_id, similarity_score, is_fallback and fallback_reason."""
    column = names.get("column", "embedding")
    found = nearest_segments(users, segments, 1, **names).withColumn("_best", F.get("nearest", F.lit(0)))
    valid = is_valid(F.col(column), dim)
    reason = F.when(~valid, "invalid_vector").when(F.col("_best").isNull(), "no_candidate").when(F.col("_best.score") < threshold, "below_threshold")
    return found.withColumn("fallback_reason", reason).select(
        *users.columns,
        F.when(reason.isNull(), F.col("_best.id")).otherwise(fallback).alias("segment_id"),
        F.when(valid, F.col("_best.score")).alias("similarity_score"),
        reason.isNotNull().alias("is_fallback"),
        "fallback_reason",
    )


def pass_rate(vectors: DataFrame, query, threshold: float, key: str, salt: str, n: int) -> DataFrame:
    """Share of a deterministic sample that reaches the threshold: sampled, passed, rate."""
    own = scored(salted_sample(vectors, key, salt, n), query)
    passed = F.count_if(F.col("score") >= threshold)
    return own.agg(F.count(F.lit(1)).alias("sampled"), passed.alias("passed"), F.round(passed / F.count(F.lit(1)), 6).alias("rate"))


#: The target and confidence of a recall audit, and the normal quantile of (1 + confidence) / 2.
TARGET_RECALL, CONFIDENCE, Z = 0.95, 0.95, 1.959963984540054


def wilson_upper(misses: Column, n: Column, z: float = Z) -> Column:
    """The upper bound of a Wilson interval for a rate of misses; 1 without trials."""
    p, size = misses / n, n.cast("double")
    middle, spread = p + z * z / (2 * size), z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return F.when(n == 0, 1.0).otherwise(F.least((middle + spread) / (1 + z * z / size), F.lit(1.0)))


def recall_audit(vectors: DataFrame, query, threshold: float, retrieved: DataFrame, key: str, salt: str, n: int, target: float = TARGET_RECALL) -> DataFrame:
    """How much of what reaches the threshold a search has retrieved, from a sample of what it hasn't.

    retrieved_positive, population (not retrieved), audited, missed, estimated_recall,
    recall_lower_bound (with the Wilson bound on the misses) and accepted.
    """
    flags = scored(vectors, query).join(retrieved.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    good = F.col("score") >= threshold
    whole = flags.agg(F.count_if(F.col("_hit") & good).alias("retrieved_positive"), F.count_if(F.col("_hit").isNull()).alias("population"))
    sample = salted_sample(flags.where("_hit IS NULL"), key, salt, n).agg(F.count(F.lit(1)).alias("audited"), F.count_if(good).alias("missed"))
    got, size, tried, missed = F.col("retrieved_positive"), F.col("population"), F.col("audited"), F.col("missed")
    recall = lambda lost: F.when(got + lost > 0, got / (got + lost)).otherwise(1.0)
    estimate = recall(F.when(tried > 0, missed / tried * size).otherwise(size.cast("double")))
    j = whole.join(F.broadcast(sample)).withColumn("estimated_recall", estimate).withColumn("recall_lower_bound", recall(wilson_upper(missed, tried) * size))
    return j.withColumn("accepted", F.col("recall_lower_bound") >= target)


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key and cluster: k centres chosen farthest first from the smallest key, then ``rounds`` of assignment and mean.

    Each step is one pass over the vectors; the driver holds k centres.
    """
    rows = vectors.select(key, unit(F.col(column)).alias("_v"))
    centres = [rows.orderBy(key).first()["_v"]]
    while len(centres) < k:
        nearest = F.greatest(*(cosine(F.col("_v"), literal(c)) for c in centres), F.lit(-2.0))
        centres.append(rows.orderBy(nearest, key).first()["_v"])
    for step in range(rounds + 1):
        own = F.transform(F.array(*(F.struct(F.lit(i).alias("i"), literal(c).alias("c")) for i, c in enumerate(centres))), lambda s: F.struct((-cosine(F.col("_v"), s["c"])).alias("far"), s["i"].alias("i")))
        assigned = rows.withColumn("cluster", F.array_min(own)["i"])
        if step < rounds:
            for r in centroids(assigned, "cluster", "_v").collect():
                centres[r["cluster"]] = r["centroid"]
    return assigned.select(key, "cluster")
