"""Behaviour vectors of 64 dimensions, each in one aggregation over the events."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import signed_coordinate, stable_bucket
from ..functions.safe import date_or_null, float_or_zero
from ..functions.text import canonical_destination
from ..functions.vectors import unit
from ..sources.event_log import instant
from .predicates import flag, is_event

# The event names of a version 1 vector, in its order.
V1_EVENTS = ("page_view", "hotel_search", "hotel_click", "hotel_detail_view", "promotion_impression", "promotion_click", "campaign_redirect_click", "campaign_landing", "booking_start", "booking_complete", "booking_cancel")
RECENCY_DAYS = 30.0
BUDGET_PRICE, PREMIUM_PRICE = 150_000, 300_000


def vector_destination() -> Column:
    """The canonical destination for vectors, where market and cluster stand in for a missing one."""
    names = ("destination_id", "destination_name", "hotel_city", "hotel_market", "hotel_cluster")
    return canonical_destination(F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit("")))


def behavior_vector_v2(events: DataFrame, window_end: datetime) -> DataFrame:
    """user_id and behavior_vector (64 doubles of length 1) of everyone with an event.

    Blocks, in order: funnel (16), destination (16 signed hash buckets), timing
    (8), benefit (8), promotion response (8), derived (8).  A user without a kind
    of event has 0 there.
    """
    count = lambda c: F.count_if(c)
    last = lambda c: F.max(F.when(c, F.col("event_time")))
    bucket, sign = signed_coordinate(F.col("_destination"))
    staged = events.withColumn("_destination", vector_destination()).withColumn("_checkin", date_or_null(F.col("checkin_date"))).withColumn("_price", float_or_zero(F.col("price")))
    staged = staged.withColumn("_bucket", bucket).withColumn("_sign", sign).withColumn("_lead", F.date_diff("_checkin", F.to_date("event_time")))
    month = F.month("_checkin")
    response = is_event("promotion_click", "campaign_landing")
    kinds = {"page": "page_view", "search": "hotel_search", "click": "hotel_click", "detail": "hotel_detail_view", "start": "booking_start", "complete": "booking_complete", "cancel": "booking_cancel", "impression": "promotion_impression", "promo": "promotion_click", "redirect": "campaign_redirect_click", "landing": "campaign_landing"}
    counts = {
        **{k: count(is_event(v)) for k, v in kinds.items()},
        "n": F.count(F.lit(1)),
        "deal": count(flag("deal")),
        "price": count(F.col("price") != ""),
        "budget": count((F.col("_price") > 0) & (F.col("_price") < BUDGET_PRICE)),
        "premium": count(F.col("_price") >= PREMIUM_PRICE),
        "cancellation": count(flag("free_cancellation")),
        "breakfast": count(flag("breakfast_included")),
        "destinations": F.count_distinct(F.when(F.col("_destination") != "", F.col("_destination"))),
        "checkins": F.count("_checkin"),
        **{s: count(month.isin(*m)) for s, m in {"spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11), "winter": (12, 1, 2)}.items()},
        "lead7": count(F.col("_lead").between(0, 7)),
        "lead30": count(F.col("_lead").between(8, 30)),
        "lead99": count(F.col("_lead") > 30),
        "weekend": count(F.weekday("_checkin").isin(5, 6)),
    }
    times = {"search_at": last(is_event("hotel_search")), "detail_at": last(is_event("hotel_detail_view")), "start_at": last(is_event("booking_start")), "response_at": last(response), "deal_at": last(flag("deal"))}
    buckets = [F.sum(F.when((F.col("_destination") != "") & (F.col("_bucket") == i), F.col("_sign")).otherwise(0.0)).alias(f"b{i}") for i in range(16)]
    users = staged.groupBy("user_id").agg(*(c.alias(f"c_{k}") for k, c in counts.items()), *(c.alias(k) for k, c in times.items()), *buckets)
    c = lambda k: F.col(f"c_{k}")
    days = lambda at: F.date_diff(F.to_date(instant(window_end)), F.to_date(at))
    intensity = lambda x: F.least(F.lit(1.0), F.log1p(x.cast("double")) / F.log1p(c("n").cast("double")))
    recency = lambda k: F.coalesce(F.exp(-days(F.col(k)).cast("double") / RECENCY_DAYS), F.lit(0.0))
    smooth = lambda a, b: (c(a) + 1.0) / (c(b) + 10.0)
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    flagged = lambda x: F.when(x, 1.0).otherwise(0.0)
    abandoned = (c("start") > c("complete")) & (c("start") > 0)
    recent = F.greatest(*(F.coalesce(F.col(k), F.lit("1970-01-01").cast("timestamp_ntz")) for k in ("search_at", "detail_at", "start_at", "response_at")))
    funnel = [intensity(c(k)) for k in ("page", "search", "click", "detail", "start", "complete", "cancel")]
    funnel += [recency(k) for k in ("search_at", "detail_at", "start_at")]
    funnel += [smooth("click", "search"), smooth("detail", "click"), smooth("start", "detail"), smooth("complete", "start"), flagged(abandoned), intensity(c("detail") + c("click"))]
    destination = [F.col(f"b{i}") / c("n") for i in range(16)]
    timing = [share(k, "checkins") for k in ("spring", "summer", "fall", "winter", "lead7", "lead30", "lead99", "weekend")]
    breadth = reduce(lambda a, b: a + b, (F.when(c(k) > 0, 1.0).otherwise(0.0) for k in ("deal", "cancellation", "breakfast")))
    benefit = [intensity(c("deal")), recency("deal_at"), intensity(c("price")), share("budget", "price"), share("premium", "price"), intensity(c("cancellation")), intensity(c("breakfast")), F.least(F.lit(1.0), breadth / 3.0)]
    promotion = [intensity(c(k)) for k in ("impression", "promo", "redirect", "landing")]
    promotion += [smooth("promo", "impression"), smooth("landing", "promo"), recency("response_at"), intensity(c("promo") + c("landing"))]
    engaged = F.when(c("detail") + c("click") >= 2, 0.34).otherwise(0.0) + F.when(abandoned, 0.33).otherwise(0.0) + F.when(c("promo") + c("landing") > 0, 0.33).otherwise(0.0)
    derived = [
        flagged(c("search") + c("click") + c("detail") > 0),
        flagged(c("destinations") == 1),
        F.least(F.lit(1.0), c("destinations") / 3.0),
        flagged(abandoned),
        flagged(c("promo") + c("landing") > 0),
        flagged(c("deal") + c("cancellation") + c("breakfast") > 0),
        flagged(days(recent) <= 30),
        F.least(F.lit(1.0), engaged),
    ]
    raw = F.array(*(x.cast("double") for x in [*funnel, *destination, *timing, *benefit, *promotion, *derived]))
    return users.select("user_id", raw.alias("_raw")).select("user_id", unit(F.col("_raw")).alias("behavior_vector"))


def behavior_vector_v1(events: DataFrame, order: str = "event_id") -> DataFrame:
    """user_id and behavior_vector: shares of event names, of hashed sources, clusters, markets and pages, and some rates.

    Buckets are by SHA-256, the portable hash of this library.  A user's prices
    are added in the given order, so that their mean doesn't depend on how the
    table is split: a running sum, of which the last is the largest.
    """
    ratio = lambda c: F.count_if(c) / F.count(F.lit(1))
    parts = [(name, n) for name, n in (("source", 4), ("hotel_cluster", 16), ("hotel_market", 16), ("page_path", 8))]
    staged = events
    for name, n in parts:
        staged = staged.withColumn(f"_{name}", F.when(F.col(name) != "", stable_bucket(F.col(name), n)))
    price = F.least(F.greatest(float_or_zero(F.col("price")) / 1_000_000.0, F.lit(0.0)), F.lit(1.0))
    so_far = Window.partitionBy("user_id").orderBy(order, "_price").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = staged.withColumn("_price", F.when(F.col("price") != "", price)).withColumn("_prices", F.sum("_price").over(so_far))
    rate = lambda a, b: F.when(F.count_if(is_event(b)) > 0, F.count_if(is_event(a)) / F.count_if(is_event(b))).otherwise(0.0)
    terms = [ratio(is_event(e)) for e in V1_EVENTS] + [ratio(~is_event(*V1_EVENTS))]
    terms += [ratio(F.col(f"_{name}") == i) for name, n in parts for i in range(n)]
    terms += [ratio(F.col(k) != "") for k in ("promotion_id", "ad_experiment_id", "segment_id")]
    terms += [ratio(flag("free_cancellation")), ratio(flag("breakfast_included")), F.coalesce(F.max("_prices") / F.count("_price"), F.lit(0.0))]
    terms += [rate("booking_complete", "booking_start"), rate("promotion_click", "promotion_impression")]
    return staged.groupBy("user_id").agg(F.array(*(t.cast("double") for t in terms)).alias("behavior_vector"))


def query_vector(signals: dict[int, float], blocks: dict[str, tuple[int, int]], weights: dict[str, float]) -> list[float]:
    """A query vector: each active block at length 1, times its weight, and the whole at length 1."""
    v = [0.0] * 64
    for name, weight in weights.items():
        lo, hi = blocks[name]
        own = {i: x for i, x in signals.items() if lo <= i <= hi}
        size = sum(x * x for x in own.values()) ** 0.5
        for i, x in own.items():
            v[i] = weight * x / size if size else 0.0
    size = sum(x * x for x in v) ** 0.5
    return [x / size for x in v] if size else v
