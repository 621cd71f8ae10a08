"""Allocation of users to segments: exclusions, winners, previews, integrity and retries.

Tables, by the columns that are read:

- members: snapshot_id, user_id, behavior_fit_score
- sources: segment_id, snapshot_id, priority, score_threshold, semantic_margin, min_sample_size
- exclusions: user_id, state, and the target's key (``TARGET_KEY``)
- targets: the target's key, status
- bindings: the target's key, run_id; runs: run_id, status
- reservations: plan_id, user_id, state, revision
- plans: plan_id, promotion_id, target_analysis_id, status
- snapshots: snapshot_id, plan_id, segment_id, source_snapshot_id, final_user_count
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import latest

TARGET_KEY = ("analysis_id", "segment_id", "plan_id", "snapshot_id")
# States that hold a user, ended run states, plan states that a retry may find.
HOLDING, ENDED, SETTLED = ("reserved", "consumed"), ("completed", "stopped", "failed", "cancelled"), ("finalized", "locked")
#: A preview has a row for each set of sources, so their number is limited by the feature itself.
MOST_PREVIEWED = 8


def active_targets(targets: DataFrame, bindings: DataFrame, runs: DataFrame, key: Sequence[str] = TARGET_KEY, ended: Sequence[str] = ENDED) -> DataFrame:
    """Targets that are not stopped and are bound to no run, or to some run that has not ended."""
    state = bindings.join(runs.select("run_id", F.col("status").alias("_run")), "run_id", "left")
    bound = state.groupBy(*key).agg(F.coalesce(F.bool_or(F.col("_run").isNotNull() & ~F.col("_run").isin(*ended)), F.lit(False)).alias("_open"))
    found = targets.where("status <> 'stopped'").join(bound, list(key), "left")
    return found.where(F.coalesce("_open", F.lit(True))).select(*targets.columns)


def excluded_users(exclusions: DataFrame, active: DataFrame, key: Sequence[str] = TARGET_KEY) -> DataFrame:
    """user_id of everyone whom an active target holds."""
    held = exclusions.where(F.col("state").isin(*HOLDING))
    return held.join(active.select(*key), list(key), "left_semi").select("user_id").distinct()


def held_users(ledger: DataFrame, user: str, revision: str, states: Sequence[str] = HOLDING) -> DataFrame:
    """The users whose latest state holds them."""
    return latest(ledger.select(user, revision, "state"), [user], [revision]).where(F.col("state").isin(*states)).select(user)


def normalized_fit() -> Column:
    return (F.col("behavior_fit_score") - F.col("score_threshold")) / F.nullif("semantic_margin", F.lit(0.0))


def _preference() -> Column:
    """The order of a user's candidate segments: priority, normalised fit (nulls last), segment id."""
    fit = normalized_fit()
    return F.struct(F.col("priority").alias("priority"), fit.isNull().alias("unknown"), (-fit).alias("far"), F.col("segment_id").alias("segment_id"))


def _candidates(members: DataFrame, sources: DataFrame, excluded: DataFrame | None) -> DataFrame:
    rows = members.join(sources, "snapshot_id")
    return rows if excluded is None else rows.join(excluded.select("user_id"), "user_id", "left_anti")


def winners(members: DataFrame, sources: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """One segment for each user: user_id, segment_id, snapshot_id, normalized_fit.

    The best candidate is an aggregation, so users' candidates are combined before the shuffle.
    """
    best = F.min_by(F.struct("segment_id", "snapshot_id", normalized_fit().alias("normalized_fit")), _preference())
    return _candidates(members, sources, excluded).groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


def audience_status(users: Column, minimum: Column) -> Column:
    return F.when(users <= 0, "no_eligible_audience").when(users < minimum, "insufficient_sample").otherwise("targetable")


def preview(members: DataFrame, sources: DataFrame, excluded: DataFrame | None = None, most: int = MOST_PREVIEWED) -> DataFrame:
    """What every non-empty set of sources would allocate: segments (sorted ids), segment_id, users, meets_min_sample_size, audience_status.

    One pass: a user's candidates in order of preference are a pattern, patterns
    are counted, and each set takes the first of a pattern that it contains.
    """
    known = sources.select(F.col("segment_id").cast("string").alias("segment_id"), "min_sample_size").orderBy("segment_id").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} sources to preview")
    ids = [r["segment_id"] for r in known]
    spark = members.sparkSession
    sets = [([ids[i] for i in range(len(ids)) if mask >> i & 1], ids[k], known[k]["min_sample_size"]) for mask in range(1, 1 << len(ids)) for k in range(len(ids)) if mask >> k & 1]
    wanted = spark.createDataFrame(sets, "segments array<string>, segment_id string, min_sample_size long")
    best = F.min(_preference()).alias("p")
    own = _candidates(members, sources.withColumn("segment_id", F.col("segment_id").cast("string")), excluded).groupBy("user_id", "segment_id").agg(best)
    patterns = own.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["segment_id"]).alias("order")).groupBy("order").agg(F.count(F.lit(1)).alias("n"))
    each = F.broadcast(wanted.select("segments").distinct())  # 2 ** most sets at most
    taken = patterns.join(each, F.arrays_overlap("order", "segments")).select("segments", "n", F.get(F.filter("order", lambda s: F.array_contains("segments", s)), F.lit(0)).alias("segment_id"))
    counts = taken.groupBy("segments", "segment_id").agg(F.sum("n").alias("users"))
    found = wanted.join(counts, ["segments", "segment_id"], "left").withColumn("users", F.coalesce("users", F.lit(0)))
    return found.select("segments", "segment_id", "users", (F.col("users") >= F.col("min_sample_size")).alias("meets_min_sample_size"), audience_status(F.col("users"), F.col("min_sample_size")).alias("audience_status"))


def integrity(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """Per snapshot: members, distinct_members, count_matches, members_distinct, not_empty."""
    counts = members.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("user_id").alias("distinct_members"))
    j = snapshots.select("snapshot_id", "final_user_count").join(counts, "snapshot_id", "left")
    n, d = F.coalesce("members", F.lit(0)), F.coalesce("distinct_members", F.lit(0))
    return j.select("snapshot_id", n.alias("members"), d.alias("distinct_members"), F.coalesce(n == F.col("final_user_count"), F.lit(False)).alias("count_matches"), (n == d).alias("members_distinct"), (n > 0).alias("not_empty"))


def wholly_reserved(snapshots: DataFrame, members: DataFrame, reservations: DataFrame, states: Sequence[str] = HOLDING) -> DataFrame:
    """snapshot_id of the snapshots with members all of whom their plan holds: no member lacks a reservation."""
    held = latest(reservations.select("plan_id", "user_id", "revision", "state"), ["plan_id", "user_id"], ["revision"]).where(F.col("state").isin(*states))
    wanted = snapshots.select("snapshot_id", "plan_id").join(members.select("snapshot_id", "user_id"), "snapshot_id")
    lacking = wanted.join(held.select("plan_id", "user_id"), ["plan_id", "user_id"], "left_anti").select("snapshot_id").distinct()
    return wanted.select("snapshot_id").distinct().join(lacking, "snapshot_id", "left_anti")


def retry(plans: DataFrame, snapshots: DataFrame, promotion_id: str, analysis_id: str, segment_ids: Sequence[str], source_ids: Sequence[str]) -> DataFrame:
    """The snapshots of settled plans that were made from just these segments and sources, for an idempotent retry."""
    own = plans.where((F.col("promotion_id") == promotion_id) & (F.col("target_analysis_id") == analysis_id) & F.col("status").isin(*SETTLED))
    rows = snapshots.join(own.select("plan_id"), "plan_id", "left_semi")
    text = lambda values: F.array(*(F.lit(v) for v in sorted(set(values)))).cast("array<string>")
    sets = rows.groupBy("plan_id").agg(F.sort_array(F.collect_set(F.col("segment_id").cast("string"))).alias("segments"), F.sort_array(F.collect_set(F.col("source_snapshot_id").cast("string"))).alias("made_of"))
    same = sets.where((F.col("segments") == text(segment_ids)) & (F.col("made_of") == text(source_ids))).select("plan_id")
    return rows.join(same, "plan_id", "left_semi")
