"""Uplift: training examples, ridge on transformed outcomes, and metrics by inverse propensity."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import first_eight
from .ranking import global_rank, group_rank


def transformed_outcome(outcome: Column, treatment: Column, probability: Column) -> Column:
    """A target whose mean given the features is the treatment effect."""
    return outcome * (treatment - probability) / (probability * (1 - probability))


def examples(units: DataFrame, outcomes: DataFrame, unit: str, user: str, start: str, end: str, outcome_at: str) -> DataFrame:
    """``units`` with outcome 1 if the user has one in [start, end), by one interval join."""
    u, o = units.alias("u"), outcomes.select(user, outcome_at).alias("o")
    inside = (F.col(f"o.{outcome_at}") >= F.col(f"u.{start}")) & (F.col(f"o.{outcome_at}") < F.col(f"u.{end}"))
    hits = u.join(o, (F.col(f"u.{user}") == F.col(f"o.{user}")) & inside, "left_semi").select(F.col(f"u.{unit}").alias(unit)).withColumn("_hit", F.lit(1))
    return units.join(hits, unit, "left").withColumn("outcome", F.coalesce("_hit", F.lit(0))).drop("_hit")


# What an assignment's manifest must say for its units to be trained on.
FINAL, DESIGN = "finalized", {"$.experiment_design.mode": "randomized_holdout", "$.outcome_spec.uplift_training_eligible": "true"}
ASSIGNMENT = ("promotion_run_id", "segment_assignment_execution_id")


def units(units: DataFrame, assignments: DataFrame, runs: DataFrame, generations: DataFrame, snapshots: DataFrame, vectors: DataFrame, project: str, at: datetime) -> DataFrame:
    """Experiment units of a project whose outcome window is over, with the facts of their assignment and their vector, null without one.

    Keys: assignments by ``ASSIGNMENT`` with uplift_assignment_status,
    input_manifest_json and source_cutoff_at; runs by promotion_run_id with
    goal_snapshot_json; generations by vector_generation_id with window_end,
    source_revision_cutoff, vector_version and manifest_hash; snapshots by
    snapshot_id with source_cutoff; vectors by vector_generation_id and user_id
    with embedding.  A unit without one of the first four is left out.
    Assignments are filtered before any join, and nothing is paged.
    """
    fit = reduce(lambda a, b: a & b, (F.get_json_object("input_manifest_json", path) == value for path, value in DESIGN.items()), F.col("uplift_assignment_status") == FINAL)
    own = assignments.where(fit).select(*ASSIGNMENT, F.col("source_cutoff_at").alias("execution_source_cutoff_at"), F.col("input_manifest_json").alias("execution_manifest"))
    named = {c: f"generation_{c}" for c in ("window_end", "source_revision_cutoff", "vector_version", "manifest_hash")}
    over = units.where((F.col("project_id") == project) & (F.col("outcome_window_end") <= F.lit(at)))
    return (
        over.join(own, list(ASSIGNMENT))
        .join(runs.select("promotion_run_id", "goal_snapshot_json"), "promotion_run_id")
        .join(generations.select("vector_generation_id", *(F.col(c).alias(n) for c, n in named.items())), "vector_generation_id")
        .join(snapshots.select(F.col("snapshot_id").alias("audience_snapshot_id"), F.col("source_cutoff").alias("audience_source_cutoff")), "audience_snapshot_id")
        .join(vectors.select("vector_generation_id", "user_id", F.col("embedding").alias("feature_vector")), ["vector_generation_id", "user_id"], "left")
    )


def ipw_rates(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Weighted outcome rates of both arms and their difference."""
    weight = F.when(F.col("treatment") == 1, 1 / F.col("probability")).otherwise(1 / (1 - F.col("probability")))
    arm = lambda t, c: F.sum(F.when(F.col("treatment") == t, c))
    rate = lambda t: arm(t, weight * F.col("outcome")) / arm(t, weight)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rate(1).alias("treatment_rate"), rate(0).alias("control_rate"), (rate(1) - rate(0)).alias("ate"))


def qini_curve(rows: DataFrame, score: str, unit: str) -> DataFrame:
    """rank and gain: the running half-weighted difference of outcomes in order of score.

    The running sum goes over the range partitions that the ranks are made in,
    shifted by what stands before each.
    """
    gain = F.when(F.col("treatment") == 1, 0.5 * F.col("outcome") / F.col("probability")).otherwise(-0.5 * F.col("outcome") / (1 - F.col("probability")))
    ranked = global_rank(rows.withColumn("_gain", gain), [F.desc(score), F.col(unit)], "rank")
    block = F.floor((F.col("rank") - 1) / 10_000)
    ranked = ranked.withColumn("_block", block)
    sums = ranked.groupBy("_block").agg(F.sum("_gain").alias("_s"))
    before = sums.select("_block", F.coalesce(F.sum("_s").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum("_gain").over(Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.join(before, "_block").select(unit, "rank", (inside + F.col("_before")).alias("gain"))


def qini_summary(curve: DataFrame) -> DataFrame:
    """auuc, its baseline (the straight line to the final gain) and qini."""
    total = curve.agg(F.count(F.lit(1)).alias("n"), F.max_by("gain", "rank").alias("final"), F.avg("gain").alias("auuc"), F.avg("rank").alias("mean_rank"))
    baseline = F.col("final") * F.col("mean_rank") / F.col("n")
    return total.select("n", "auuc", baseline.alias("auuc_baseline"), (F.col("auuc") - baseline).alias("qini"))


def uplift_at(rows: DataFrame, score: str, unit: str, fractions: Sequence[float]) -> DataFrame:
    """Observed uplift among the top shares by score: fraction, n, ate."""
    ranked = global_rank(rows, [F.desc(score), F.col(unit)], "_rank")
    n = rows.count()
    cut = F.greatest(F.lit(1), F.ceil(F.lit(n) * F.col("fraction")))
    top = ranked.withColumn("fraction", F.explode(F.array(*(F.lit(float(f)) for f in fractions)))).where(F.col("_rank") <= cut)
    return ipw_rates(top, ["fraction"]).select("fraction", "n", "ate")


@dataclass(frozen=True)
class Ridge:
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float

    def column(self, features: Sequence[Column]) -> Column:
        z = F.lit(self.intercept)
        for x, m, s, c in zip(features, self.means, self.scales, self.coefficients, strict=True):
            z = z + c * (x - m) / s
        return z


def fit_ridge(rows: DataFrame, features: Sequence[str], target: str, strength: float = 1.0) -> Ridge:
    """Ridge regression on standardised features; the intercept isn't penalised.

    Moments come from one aggregation; the driver solves a system of as many
    unknowns as there are features.
    """
    import numpy as np

    k, names = len(features), [*features, target]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]).cast("double") * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    n = got["n"]
    s = np.array([got[f"s{i}"] for i in range(k + 1)])
    p = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        p[i, j] = p[j, i] = got[f"p{i}_{j}"]
    cov = p - np.outer(s, s) / n
    scales = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0))
    scales[scales == 0] = 1.0
    normal = cov[:k, :k] / np.outer(scales, scales) + strength * np.eye(k)
    coefficients = np.linalg.solve(normal, cov[:k, k] / scales)
    return Ridge((s[:k] / n).tolist(), scales.tolist(), coefficients.tolist(), float(s[k] / n))


def time_split(rows: DataFrame, experiment: str, ended_at: str, test_share: float = 0.2) -> DataFrame:
    """``rows`` with ``is_test``: the experiments that ended last, a share of them and at least one."""
    ends = rows.groupBy(experiment).agg(F.max(ended_at).alias("_end"))
    n = ends.count()
    last = ends.orderBy(F.desc("_end"), F.desc(experiment)).limit(max(1, math.ceil(n * test_share))).select(experiment, F.lit(True).alias("_test"))
    return rows.join(last, experiment, "left").withColumn("is_test", F.coalesce("_test", F.lit(False))).drop("_test")


def stratified_split(rows: DataFrame, unit: str, strata: Sequence[str], train_share: float = 0.7) -> DataFrame:
    """``rows`` with ``is_train``: in each stratum the first ``floor(n * share)`` by stable hash."""
    ranked = group_rank(rows, strata, [first_eight(F.col(unit).cast("string")), F.col(unit)])
    return ranked.withColumn("is_train", F.col("_rank") <= F.floor(F.col("_n") * train_share)).drop("_rank", "_n")


def percentile(ordered: Sequence[float], quantile: float) -> float:
    """Linear interpolation between neighbours."""
    at = (len(ordered) - 1) * quantile
    low = int(at)
    share = at - low
    return ordered[low] * (1 - share) + ordered[min(low + 1, len(ordered) - 1)] * share


def cluster_bootstrap(clusters: Sequence[tuple[float, int]], draws: int = 1000, seed: int = 20260721) -> tuple[float | None, float | None]:
    """A 95 % interval of a mean over resampled clusters, each given as sum and count, in the order of their ids; none for fewer than two; driver-side."""
    if draws < 1:
        raise ValueError("draws must be positive")
    if len(clusters) < 2:
        return None, None
    rng, means = random.Random(seed), []
    for _ in range(draws):
        picked = [rng.choice(clusters) for _ in clusters]
        means.append(sum(s for s, _ in picked) / sum(n for _, n in picked))
    means.sort()
    return percentile(means, 0.025), percentile(means, 0.975)


def out_of_range(rows: DataFrame, features: Sequence[str], model: Ridge) -> DataFrame:
    """The largest absolute standardised value of each feature."""
    return rows.agg(*(F.max(F.abs((F.col(f) - m) / s)).alias(f) for f, m, s in zip(features, model.means, model.scales, strict=True)))
