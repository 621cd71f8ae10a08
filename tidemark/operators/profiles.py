"""User profiles, candidate segments and their scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import date_or_null, float_or_null
from ..functions.text import contains_any
from .predicates import destination_text, flag, is_event
from .ranking import group_rank

# Prior users of a smoothed rate and the score weights.
PRIOR_USERS = 30.0
SCORE_WEIGHTS = {"promotion_condition_match": 0.15, "expected_goal_performance": 0.70, "behavior_lift_vs_baseline": 0.06, "sample_reliability": 0.06, "rank_distinctiveness": 0.03}
DESTINATION_SCORE_WEIGHTS = {"promotion_condition_match": 0.10, "expected_goal_performance": 0.85, "behavior_lift_vs_baseline": 0.02, "sample_reliability": 0.02, "rank_distinctiveness": 0.01}

COUNTED = ("hotel_search", "hotel_click", "hotel_detail_view", "promotion_impression", "promotion_click", "campaign_redirect_click", "campaign_landing", "booking_start", "booking_complete", "booking_cancel")


def distinct_values(c: Column, most: int) -> Column:
    """At most so many distinct values, the smallest ones, so that the choice is the same in every run."""
    return F.slice(F.sort_array(F.collect_set(c)), 1, most)


def user_signals(events: DataFrame, destination_terms: Sequence[str] = (), months: Sequence[int] = ()) -> DataFrame:
    """A profile row for each user: counts, average price, bounded value lists and matches with the promotion's terms."""
    here = contains_any(destination_text(), destination_terms)
    in_season = F.coalesce(F.month(date_or_null(F.col("checkin_date"))).isin(*months), F.lit(False)) if months else F.lit(True)
    search = is_event("hotel_search")
    anywhere = here if destination_terms else F.lit(True)
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        *(F.count_if(is_event(n)).alias(f"{n}_count") for n in COUNTED),
        F.count_if(F.col("deal") != "").alias("deal_event_count"),
        F.count_if(flag("free_cancellation")).alias("free_cancellation_count"),
        F.count_if(flag("breakfast_included")).alias("breakfast_included_count"),
        F.count_if(F.col("price") != "").alias("price_event_count"),
        F.avg(F.when(F.col("price") != "", float_or_null(F.col("price")))).alias("avg_price"),
        distinct_values(destination_text(), 20).alias("destination_values"),
        distinct_values(F.col("hotel_market"), 20).alias("hotel_market_values"),
        distinct_values(F.col("hotel_cluster"), 20).alias("hotel_cluster_values"),
        distinct_values(F.col("age_group"), 10).alias("age_group_values"),
        distinct_values(F.col("gender"), 10).alias("gender_values"),
        F.count_if(here).alias("destination_match_count"),
        F.count_if(in_season if months else F.lit(False)).alias("season_match_count"),
        F.count_if(search & anywhere & in_season).alias("promotion_condition_search_count"),
        F.count_if(search & (F.lower("deal") == "true")).alias("deal_search_count"),
        F.count_if(search & flag("free_cancellation")).alias("free_cancellation_search_count"),
        F.max("event_time").alias("last_event_at"),
    )


def n(name: str) -> Column:
    return F.col(f"{name}_count")


def excluded(behaviors: Sequence[str]) -> Column:
    """Whether a profile shows one of the behaviours."""
    response = (n("promotion_click") > 0) | (n("campaign_redirect_click") > 0) | (n("campaign_landing") > 0)
    known = {k: n(k) > 0 for k in ("booking_complete", "booking_cancel", "booking_start", "hotel_search", "hotel_detail_view")} | {"promotion_response": response}
    out = F.lit(False)
    for b in behaviors:
        out = out | known[b]
    return out


def demographic(ages: Sequence[str] = (), genders: Sequence[str] = ()) -> Column:
    ok = F.lit(True)
    for column, wanted in (("age_group_values", ages), ("gender_values", genders)):
        if wanted:
            ok = ok & F.arrays_overlap(F.col(column), F.array(*(F.lit(w) for w in wanted)))
    return ok


def candidate(kind: str, destination: bool = False, season: bool = False) -> Column:
    """Whether a profile belongs to a candidate segment of this type."""
    looked = n("hotel_search") + n("hotel_detail_view") > 0
    here = n("destination_match") > 0 if destination else F.lit(True)
    benefit = n("deal_event") + n("free_cancellation") + n("breakfast_included") + n("price_event")
    return {
        "intent_matched": looked & here & (n("season_match") > 0 if season else F.lit(True)),
        "target_destination_affinity": (n("destination_match") >= 2) & looked,
        "funnel_recovery": (n("booking_start") > n("booking_complete")) & here,
        "promotion_responsive": (n("promotion_click") > 0) | (n("campaign_landing") > 0) | ((n("promotion_impression") > 0) & (n("promotion_click") / F.nullif(n("promotion_impression"), F.lit(0)) >= 0.15)),
        "general_destination_explorer": ((F.size("destination_values") >= 2) | (F.size("hotel_market_values") >= 2) | (F.size("hotel_cluster_values") >= 2)) & looked,
        "benefit_value_seeker": (benefit > 0) & here,
    }[kind]


CANDIDATES = ("intent_matched", "target_destination_affinity", "funnel_recovery", "promotion_responsive", "general_destination_explorer", "benefit_value_seeker")


def strength(kind: str) -> Column:
    """How strongly a profile shows a candidate's behaviour."""
    m = 2.0 * n("destination_match")
    return {
        "intent_matched": m + 1.5 * n("season_match") + n("hotel_detail_view") + 0.5 * n("hotel_search"),
        "funnel_recovery": m + 2.0 * F.greatest(n("booking_start") - n("booking_complete"), F.lit(0)) + n("hotel_detail_view"),
        "promotion_responsive": 2.0 * n("promotion_click") + n("campaign_landing") + 0.25 * n("promotion_impression"),
        "target_destination_affinity": m + n("hotel_detail_view") + 0.5 * n("hotel_search"),
        "general_destination_explorer": F.size("destination_values") + F.size("hotel_market_values") + n("hotel_search") + 0.0,
        "benefit_value_seeker": m + n("deal_event") + n("free_cancellation") + n("breakfast_included") + 0.5 * n("price_event"),
    }[kind]


def smoothed_rate(successes: Column, size: Column, baseline: Column) -> Column:
    """A success rate with ``PRIOR_USERS`` users at the baseline rate and half a success and failure added."""
    b = F.least(F.greatest(baseline, F.lit(0.0)), F.lit(1.0))
    won, lost = 0.5 + PRIOR_USERS * b, 0.5 + PRIOR_USERS * (1 - b)
    return F.when(size <= 0, b).otherwise((successes + won) / (size + won + lost))


def baseline_metrics(profiles: DataFrame) -> DataFrame:
    """Events per user and shares of users with any, for each counted event, in one row."""
    keys = ("hotel_search", "hotel_detail_view", "promotion_click", "campaign_landing", "booking_start", "booking_complete", "destination_match")
    return profiles.agg(*(F.avg(n(k)).alias(k) for k in keys), *(F.avg(F.when(n(k) > 0, 1.0).otherwise(0.0)).alias(f"{k}_user_rate") for k in keys))


def lift(metric: Column, baseline: Column) -> Column:
    """Lift over the baseline, halved and cut at 1; 1 or 0.5 where the baseline has none."""
    return F.when(baseline <= 0, F.when(metric > 0, 1.0).otherwise(0.5)).otherwise(F.least(metric / (baseline * 2.0), F.lit(1.0)))


def reliability(size: Column, minimum: int) -> Column:
    return F.least(size / float(max(minimum * 3, 1)), F.lit(1.0)) if minimum > 0 else F.lit(1.0)


def final_score(parts: dict[str, Column], destination_required: bool = False, beam: Column | None = None) -> Column:
    weights = DESTINATION_SCORE_WEIGHTS if destination_required else SCORE_WEIGHTS
    score = F.lit(0.0)
    for key, weight in weights.items():
        score = score + weight * parts[key]
    return score if beam is None else 0.55 * score + 0.45 * beam


def candidate_sizes(profiles: DataFrame, conditions: dict[str, Column], success: Column) -> DataFrame:
    """name, users and successes of every candidate, from one pass over the profiles."""
    counts = profiles.agg(*(F.struct(F.lit(k).alias("name"), F.count_if(c).alias("users"), F.count_if(c & success).alias("successes")).alias(f"_{i}") for i, (k, c) in enumerate(conditions.items())))
    return counts.select(F.explode(F.array(*(f"_{i}" for i in range(len(conditions))))).alias("r")).select("r.*")


# The event count whose lift speaks for each type, and the reliability from which a candidate is a main one.
LIFT_METRIC = {"intent_matched": "hotel_detail_view", "funnel_recovery": "booking_start", "promotion_responsive": "promotion_click", "target_destination_affinity": "destination_match", "general_destination_explorer": "hotel_search", "benefit_value_seeker": "benefit"}
PRIMARY_RELIABILITY = 0.75


def lift_metric(kind: str) -> Column:
    key = LIFT_METRIC.get(kind, "hotel_search")
    return n("deal_event") + n("free_cancellation") + n("breakfast_included") + n("price_event") if key == "benefit" else n(key)


def score_candidates(profiles: DataFrame, conditions: dict[str, Column], success: Column, minimum: int, destination_required: bool = False) -> DataFrame:
    """name, users, the parts of the score, score and tier of every candidate type, from one pass over the profiles.

    Distinctiveness is that of a candidate on its own, 1.
    """
    total, won = F.count(F.lit(1)), F.count_if(success)
    own = lambda k, c: F.struct(F.lit(k).alias("name"), F.count_if(c).alias("users"), F.count_if(c & success).alias("successes"), F.sum(F.when(c, lift_metric(k))).alias("metric"), F.avg(lift_metric(k)).alias("everyone"), total.alias("total"), (won / total).alias("rate"))
    rows = profiles.agg(*(own(k, c).alias(f"_{i}") for i, (k, c) in enumerate(conditions.items())))
    rows = rows.select(F.explode(F.array(*(f"_{i}" for i in range(len(conditions))))).alias("r")).select("r.*")
    users = F.col("users")
    parts = {
        "promotion_condition_match": F.coalesce(users / F.nullif("total", F.lit(0)), F.lit(0.0)),
        "expected_goal_performance": smoothed_rate(F.col("successes"), users, F.coalesce("rate", F.lit(0.0))),
        "behavior_lift_vs_baseline": lift(F.coalesce("metric", F.lit(0)) / F.greatest(users, F.lit(1)), F.coalesce("everyone", F.lit(0.0))),
        "sample_reliability": reliability(users, minimum),
        "rank_distinctiveness": F.lit(1.0),
    }
    rows = rows.select("name", "users", *(c.alias(k) for k, c in parts.items()))
    score = final_score({k: F.col(k) for k in parts}, destination_required)
    return rows.withColumn("score", score).withColumn("tier", F.when(F.col("sample_reliability") < PRIMARY_RELIABILITY, "small_high_intent").otherwise("primary"))


def pick_portfolio(scores: list[tuple[str, int, float]], overlap: dict[tuple[str, str], float], most: int = 3, limit: float = 0.70) -> list[str]:
    """Greedy choice by tier, score and name of candidates that overlap with none chosen before by ``limit`` or more."""
    chosen: list[str] = []
    for name, _, _ in sorted(scores, key=lambda s: (s[1], -s[2], s[0])):
        if len(chosen) < most and all(overlap.get((min(name, c), max(name, c)), 0.0) < limit for c in chosen):
            chosen.append(name)
    return chosen


def ratio_evaluation(users: DataFrame, group: str, score: str, outcome: str, tie: str, ratios: Sequence[float]) -> DataFrame:
    """For each ratio: users in the top share of their group, their outcome rate, and its lift over everyone's."""
    ranked = group_rank(users, [group], [F.desc(score), F.col(tie)])
    picked = ranked.withColumn("ratio", F.explode(F.array(*(F.lit(float(r)) for r in ratios)))).withColumn("_in", F.col("_rank") <= F.ceil(F.col("_n") * F.col("ratio")))
    rate = F.avg(F.when(F.col("_in"), F.col(outcome).cast("double")))
    return picked.groupBy("ratio").agg(F.count_if("_in").alias("selected"), rate.alias("rate"), (rate - F.avg(F.col(outcome).cast("double"))).alias("lift"))
