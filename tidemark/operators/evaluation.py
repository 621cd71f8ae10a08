"""Campaign evaluation: inflow, ordered funnels, cohorts, statuses."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import float_or_null, ratio6
from ..sources.event_log import instant
from .intervals import days_before, until
from .predicates import is_event
from .ranking import lower_median, pinned

EPOCH = "1970-01-01"
HIGH_PRICE = 200_000.0


def no_event() -> Column:
    """The time of what didn't happen."""
    return F.lit(EPOCH).cast("timestamp_ntz")


def _last(*names: str) -> Column:
    return F.max(F.when(is_event(*names), F.col("event_time")))


def inflow(touches: DataFrame, cutoff: datetime, by: Sequence[str] = ("ad_experiment_id",)) -> DataFrame:
    """Per experiment, distinct attribution keys that landed and that clicked the redirect.

    The key is the redirect where there is one, else the user.
    """
    key = F.when(F.coalesce("redirect_id", F.lit("")) != "", F.concat(F.lit("redirect:"), "redirect_id")).otherwise(F.concat(F.lit("user:"), "user_id"))
    rows = touches.where(is_event("campaign_redirect_click", "campaign_landing") & (F.col("event_time") <= instant(cutoff)) & ((F.coalesce("redirect_id", F.lit("")) != "") | (F.col("user_id") != "")))
    own = lambda e: F.count_distinct(F.when(is_event(e), key))
    return rows.groupBy(*by).agg(own("campaign_landing").alias("numerator"), own("campaign_redirect_click").alias("denominator"))


def responses(touches: DataFrame, event: str, cutoff: datetime) -> DataFrame:
    """ad_experiment_id, user_id, response_at (the first) and fixture_response."""
    rows = touches.where(is_event(event) & (F.col("event_time") <= instant(cutoff)) & (F.col("user_id") != ""))
    return rows.groupBy("ad_experiment_id", "user_id").agg(F.min("event_time").alias("response_at"), F.bool_or(F.col("source") == "fixture").alias("fixture_response"))


def funnel(touches: DataFrame, browsing: DataFrame, bookings: DataFrame, response_event: str, cutoff: datetime) -> DataFrame:
    """Per experiment, users who reached each stage after their first response, all experiments in one job.

    A later stage counts for the earlier ones; what didn't happen is at the epoch.
    """
    keys = ["ad_experiment_id", "user_id"]
    known = lambda d: d.where((F.col("event_time") <= instant(cutoff)) & (F.col("user_id") != ""))
    seen = known(browsing.where(is_event("hotel_search", "hotel_click", "hotel_detail_view"))).groupBy(*keys).agg(F.max("event_time").alias("search_at"), _last("hotel_detail_view").alias("detail_at"))
    booked = known(bookings.where(is_event("booking_start", "booking_complete"))).groupBy(*keys).agg(_last("booking_start").alias("start_at"), _last("booking_complete").alias("complete_at"))
    at = lambda c: F.coalesce(c, no_event())
    users = responses(touches, response_event, cutoff).join(seen, keys, "left").join(booked, keys, "left")
    stages = {"complete": at("complete_at"), "start": F.greatest(at("start_at"), at("complete_at"))}
    stages["detail"] = F.greatest(at("detail_at"), stages["start"])
    stages["search"] = F.greatest(at("search_at"), stages["detail"])
    reached = lambda k: F.count_if(stages[k] >= F.col("response_at"))
    return users.groupBy("ad_experiment_id").agg(
        F.count(F.lit(1)).alias("response_count"), reached("search").alias("hotel_search_count"), reached("detail").alias("hotel_detail_view_count"), reached("start").alias("booking_start_count"), reached("complete").alias("booking_complete_count"), F.count_if("fixture_response").alias("fixture_response_count")
    )


def booking_intent_cohorts(touches: DataFrame, events: DataFrame, bookings: DataFrame, response_event: str, cutoff: datetime, lookback_days: int = 30) -> DataFrame:
    """Per experiment: repeat viewers against others, abandoners, price levels and medians.

    A median of an even count is the lower of the two in the middle.
    """
    first = responses(touches, response_event, cutoff)
    exp, user = F.col("a.ad_experiment_id").alias("ad_experiment_id"), F.col("a.user_id").alias("user_id")
    views = days_before(first, events.where(is_event("hotel_detail_view")), "user_id", "response_at", "event_time", lookback_days).groupBy(exp, user).agg(F.count("e.event_id").alias("views"))
    name, time, revenue = F.col("e.event_name"), F.col("e.event_time"), F.col("e.revenue")
    own = bookings.where(is_event("booking_start", "booking_complete"))
    j = until(first, own, "user_id", "response_at", "event_time", instant(cutoff)).where(F.col("e.user_id").isNull() | (F.col("a.ad_experiment_id") == F.col("e.ad_experiment_id")))
    journeys = j.groupBy(exp, user).agg(
        F.max(F.when(name == "booking_start", time)).alias("start_at"),
        F.max(F.when(name == "booking_complete", time)).alias("complete_at"),
        F.max_by(F.when((name == "booking_start") & revenue.isNotNull(), revenue), F.when((name == "booking_start") & revenue.isNotNull(), F.struct(time, F.col("e.event_id")))).alias("revenue"),
    )
    priced = events.where(is_event("booking_start")).withColumn("_price", float_or_null(F.nullif("price", F.lit("")))).where("_price IS NOT NULL")
    prices = until(first, priced, "user_id", "response_at", "event_time", instant(cutoff), "inner").groupBy(exp, user).agg(F.max_by("e._price", F.struct("e.event_time", "e.event_id")).alias("nightly"))
    keys = ["ad_experiment_id", "user_id"]
    u = first.join(views, keys, "left").join(journeys, keys, "left").join(prices, keys, "left")
    start, done = F.coalesce("start_at", no_event()), F.coalesce("complete_at", no_event())
    repeat, booked = F.coalesce("views", F.lit(0)) >= 2, (done >= start) & (done != no_event())
    abandoned, completed = (start != no_event()) & (done == no_event()), done != no_event()
    high = F.coalesce(F.col("nightly") > HIGH_PRICE, F.lit(False))
    u = u.withColumn("_abandoned", abandoned).withColumn("_completed", completed)
    # read twice, and as wide as a few numbers for each user
    u = pinned(u.select("ad_experiment_id", "views", "start_at", "complete_at", "nightly", "_abandoned", "_completed", F.col("revenue").cast("double").alias("revenue")))
    counts = u.groupBy("ad_experiment_id").agg(
        F.count_if(repeat).alias("repeat_view_user_count"),
        F.count_if(repeat & booked).alias("repeat_view_booking_count"),
        F.count_if(~repeat).alias("comparison_user_count"),
        F.count_if(~repeat & booked).alias("comparison_booking_count"),
        F.count_if(abandoned).alias("booking_abandon_user_count"),
        F.count_if(completed).alias("booking_complete_user_count"),
        F.count_if((start != no_event()) & high).alias("high_price_booking_start_user_count"),
        F.count_if(abandoned & high).alias("high_price_booking_abandon_user_count"),
        F.count_if(completed & high).alias("high_price_booking_complete_user_count"),
    )
    arms, prices = {"abandon": "_abandoned", "complete": "_completed"}, {"revenue": "revenue", "nightly_price": "nightly"}
    wanted = {f"booking_{k}_median_{n}": (flag, c) for n, c in prices.items() for k, flag in arms.items()}
    values = F.array(*(F.struct(F.lit(name).alias("figure"), F.when(F.col(flag), F.col(c)).alias("value")) for name, (flag, c) in wanted.items()))
    medians = lower_median(u.select("ad_experiment_id", F.inline(values)), ["ad_experiment_id", "figure"], "value")
    wide = medians.groupBy("ad_experiment_id").agg(*(F.max(F.when(F.col("figure") == name, F.col("median"))).alias(name) for name in wanted))
    return counts.join(wide, "ad_experiment_id", "left")


def dropoff(stages: DataFrame, group: str, order: str, users: str) -> DataFrame:
    """``stages`` with conversion from and drop-off since the stage before; null for the first."""
    before = F.lag(users).over(Window.partitionBy(group).orderBy(order))
    lost = F.greatest(before - F.col(users), F.lit(0))
    first = before.isNull()
    return stages.withColumn("conversion_rate", F.when(~first, ratio6(F.col(users), before))).withColumn("dropoff_count", F.when(~first, lost)).withColumn("dropoff_rate", F.when(~first, ratio6(lost, before)))


def goal_status(actual: Column, target: Column, denominator: Column, sample: Column, minimum: int) -> Column:
    return F.when((denominator == 0) | (sample < minimum), "insufficient_data").when(actual >= target, "goal_met").otherwise("goal_not_met")


def evidence_strength(sample: Column, minimum: int, detailed: int = 100) -> Column:
    return F.when(sample == 0, "unavailable").when(sample < minimum, "insufficient").when(sample < detailed, "limited").otherwise("sufficient")


def run_status(evaluations: DataFrame, run: str, status: str = "status") -> DataFrame:
    """One status for each run from those of its segments."""
    total = F.count(F.lit(1))
    is_ = lambda s: F.count_if(F.col(status) == s)
    all_in = F.when(is_("goal_met") == total, "goal_met").when(is_("insufficient_data") == total, "insufficient_data").when((is_("goal_met") == 0) & (is_("goal_not_met") > 0), "goal_not_met").otherwise("partial_goal_met")
    return evaluations.groupBy(run).agg(total.alias("segments"), all_in.alias("run_status"))
