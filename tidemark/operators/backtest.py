"""Hotel search logs: event explosion, scenarios, and temporal backtests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event names, second offsets and rules of the explosion.
STEPS = (("page_view", -2, "expedia_row_seen"), ("hotel_search", 0, "expedia_search_row"), ("hotel_detail_view", 5, "hotel_candidate_present"), ("hotel_click", 10, "cnt_or_booking_intent"), ("booking_start", 20, "booking_or_high_cnt_abandonment"), ("booking_complete", 40, "observed_booking"))


def explode_events(rows: DataFrame) -> DataFrame:
    """Each search row as up to six events in order, with event_name, offset and rule."""
    booked = F.col("is_booking") == 1
    holds = {"hotel_click": (F.col("cnt") >= 2) | booked, "booking_start": booked | (F.col("cnt") >= 4), "booking_complete": booked}
    every = F.array(*(F.when(holds.get(name, F.lit(True)), F.struct(F.lit(name).alias("event_name"), F.lit(at).alias("offset"), F.lit(rule).alias("rule"))) for name, at, rule in STEPS))
    return rows.select("*", F.inline(F.filter(every, lambda s: s.isNotNull())))


def derived(rows: DataFrame) -> DataFrame:
    """``rows`` with stay, lead time, room type, category, deal, benefit flags and an estimated price."""
    days = lambda a, b: F.coalesce(F.greatest(F.date_diff(b, a), F.lit(0)), F.lit(0))
    c = F.col
    rows = rows.withColumn("stay_nights", F.when(c("srch_ci").isNull() | c("srch_co").isNull(), 0).otherwise(days(c("srch_ci"), c("srch_co")))).withColumn("booking_window_days", F.when(c("srch_ci").isNull(), 0).otherwise(days(F.to_date("date_time"), c("srch_ci"))))
    package, window, nights = c("is_package") == 1, c("booking_window_days"), c("stay_nights")
    room = F.when(c("srch_rm_cnt") >= 2, "multi_room").when(c("srch_children_cnt") > 0, "family_room").when(c("srch_adults_cnt") == 1, "single_room").otherwise("standard_room")
    category = F.when(c("srch_children_cnt") > 0, "family_travel").when(package, "package_travel").when((c("srch_adults_cnt") == 1) & (nights <= 2), "business_or_solo_travel").when(window <= 7, "last_minute_travel").otherwise("leisure_travel")
    deal = F.when(package, "package_bundle").when(window >= 30, "early_booking").when(c("cnt") >= 4, "comparison_deal").otherwise("")
    one = F.lit(1)
    price = (
        65000 + c("hotel_continent") * 7000 + F.pmod(c("hotel_country"), F.lit(80)) * 900 + F.pmod(c("hotel_market"), F.lit(120)) * 450
        + F.greatest(c("srch_rm_cnt"), one) * 22000 + F.greatest(c("srch_adults_cnt"), one) * 9000 + c("srch_children_cnt") * 6000
        + F.when(package, -12000).otherwise(0) + F.when(window <= 7, 18000).otherwise(0)
    )
    return rows.withColumn("room_type", room).withColumn("preferred_category", category).withColumn("deal", deal).withColumn("free_cancellation", F.when((window >= 14) | package, "1").otherwise("0")).withColumn("breakfast_included", F.when(package & (nights >= 2), "1").otherwise("0")).withColumn("estimated_price", F.greatest(F.lit(45000), price).cast("long"))


def _some_values(c: Column, most: int) -> Column:
    return F.slice(F.sort_array(F.collect_set(c)), 1, most)


def observed_profiles(rows: DataFrame, start: str, cutoff: str, target: int, months: Sequence[int] = ()) -> DataFrame:
    """A profile of each user from the search rows in [start, cutoff), as the events they explode to would give it.

    Columns are those that candidates are tested on; what a search log can't
    show is 0, null or an empty list, and of value lists the smallest are kept.
    """
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    seen = rows.where((F.col("date_time") >= at(start)) & (F.col("date_time") < at(cutoff)))
    booked = F.col("is_booking") == 1
    clicked, started = (F.col("cnt") >= 2) | booked, booked | (F.col("cnt") >= 4)
    kind = F.when(F.col("srch_children_cnt") > 0, "family_travel").when(F.col("is_package") == 1, "package_travel").when(F.col("srch_adults_cnt") == 1, "business_or_solo_travel").otherwise("leisure_travel")
    n, clicks, starts, done = F.count(F.lit(1)), F.count_if(clicked), F.count_if(started), F.count_if(booked)
    text = lambda c: F.col(c).cast("string")
    none, empty = ("promotion_impression", "promotion_click", "campaign_redirect_click", "campaign_landing", "booking_cancel", "free_cancellation", "breakfast_included", "price_event"), ("age_group_values", "gender_values")
    return (
        seen.groupBy("user_id")
        .agg(
            (n * 3 + clicks + starts + done).alias("event_count"),
            n.alias("hotel_search_count"),
            clicks.alias("hotel_click_count"),
            n.alias("hotel_detail_view_count"),
            starts.alias("booking_start_count"),
            done.alias("booking_complete_count"),
            F.count_if(F.col("is_package") == 1).alias("deal_event_count"),
            _some_values(text("srch_destination_id"), 20).alias("destination_values"),
            _some_values(F.coalesce(text("srch_ci"), F.lit("")), 20).alias("checkin_dates"),
            _some_values(text("hotel_market"), 20).alias("hotel_market_values"),
            _some_values(text("hotel_cluster"), 20).alias("hotel_cluster_values"),
            _some_values(kind, 10).alias("preferred_category_values"),
            F.count_if(F.col("srch_destination_id") == target).alias("destination_match_count"),
            F.count_if(F.month("srch_ci").isin(*months) if months else F.lit(False)).alias("season_match_count"),
        )
        .select("*", *(F.lit(0).cast("long").alias(f"{c}_count") for c in none), F.lit(None).cast("double").alias("avg_price"), *(F.array().cast("array<string>").alias(c) for c in empty))
    )


def temporal_backtest(rows: DataFrame, conditions: dict[str, Column], start: str, cutoff: str, end: str, target: int, months: Sequence[int] = ()) -> DataFrame:
    """For each candidate its users before the cutoff and those who booked the target in [cutoff, end), beside everyone's.

    name, users, booked, actual, everyone, baseline and lift_pp; all candidates come from one pass over the profiles.
    """
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    later = future_outcome(rows.where((F.col("date_time") >= at(cutoff)) & (F.col("date_time") < at(end))), target, months).where("contextual_booking")
    known = observed_profiles(rows, start, cutoff, target, months).join(later, "user_id", "left")
    won = F.coalesce("contextual_booking", F.lit(False))
    everyone = (F.count(F.lit(1)).alias("everyone"), F.count_if(won).alias("won"))
    sums = known.agg(*everyone, *(F.struct(F.lit(k).alias("name"), F.count_if(c).alias("users"), F.count_if(c & won).alias("booked")).alias(f"_{i}") for i, (k, c) in enumerate(conditions.items())))
    found = sums.select("everyone", "won", F.inline(F.array(*(f"_{i}" for i in range(len(conditions))))))
    actual, baseline = F.col("booked") / F.nullif("users", F.lit(0)), F.col("won") / F.nullif("everyone", F.lit(0))
    return found.select("name", "users", "booked", actual.alias("actual"), "everyone", baseline.alias("baseline"), ((actual - baseline) * 100).alias("lift_pp"))


def scenarios(rows: DataFrame, minimum_users: int, most: int, excluded: Sequence[int] = ()) -> DataFrame:
    """Destinations with enough users, most users first."""
    own = rows.where(F.col("srch_destination_id") > 0)
    if excluded:
        own = own.where(~F.col("srch_destination_id").isin(*excluded))
    found = own.groupBy("srch_destination_id").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n_rows")).where(F.col("users") >= minimum_users)
    return found.orderBy(F.desc("users"), F.desc("n_rows"), "srch_destination_id").limit(most)


def future_outcome(rows: DataFrame, target: int, months: Sequence[int] = ()) -> DataFrame:
    """user_id and whether any of the user's bookings is at the target destination, in these check-in months if any are given."""
    here = F.col("srch_destination_id") == target
    if months:
        here = here & F.coalesce(F.month("srch_ci").isin(*months), F.lit(False))
    return rows.where("is_booking = 1").groupBy("user_id").agg(F.bool_or(here).alias("contextual_booking"))


def training_cells(rows: DataFrame, most: int) -> DataFrame:
    """Counts and bookings by device, package, capped stay and capped lead time; the largest cells first."""
    days = lambda a, b: F.date_diff(b, a)
    cap = lambda x, top: F.least(F.greatest(x, F.lit(0)), F.lit(top))
    stay = F.when(F.col("srch_ci").isNull() | F.col("srch_co").isNull(), 0).otherwise(cap(days(F.col("srch_ci"), F.col("srch_co")), 14))
    lead = F.when(F.col("srch_ci").isNull(), 30).otherwise(cap(days(F.to_date("date_time"), F.col("srch_ci")), 60))
    keys = ["is_mobile", "is_package", "stay_nights", "days_until_checkin"]
    cells = rows.withColumn("stay_nights", stay.cast("int")).withColumn("days_until_checkin", lead.cast("int")).groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("is_booking") == 1).alias("booking_count"))
    return cells.orderBy(F.desc("event_count"), *keys).limit(most)


def brier(results: DataFrame, predicted: Column, size: Column, successes: Column, by: Sequence[str] = ()) -> DataFrame:
    """Brier score, mean absolute error and bias of predicted rates over groups of users, for each value of ``by`` if given."""
    p = F.least(F.greatest(predicted, F.lit(0.0)), F.lit(1.0))
    lost = F.greatest(size - successes, F.lit(0))
    error = F.sum(successes * (1 - p) * (1 - p) + lost * p * p)
    actual = successes / size
    return results.groupBy(*by).agg(F.when(F.sum(size) > 0, error / F.sum(size)).otherwise(0.0).alias("brier"), F.avg(F.abs(p - actual)).alias("mae"), F.avg(p - actual).alias("bias"))


def _tied(a: Column, b: Column) -> Column:
    """Equal within a billionth of the larger, or within 1e-12."""
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))


def rank_quality(outcomes: DataFrame, scenario: str) -> DataFrame:
    """One row of figures over the scenarios whose first ranked candidate has a baseline above 0.

    ``outcomes`` has scenario, rank, actual and baseline; ranks 1 to 3 count, each
    once in a scenario, so a scenario is one row of an aggregation and its pairs
    are columns.  Rates without a denominator are null, means without values 0.
    """
    at = lambda r: F.max(F.when(F.col("rank") == r, F.struct("actual", "baseline")))
    rows = outcomes.where(F.col("rank").between(1, 3)).groupBy(scenario).agg(*(at(r).alias(f"r{r}") for r in (1, 2, 3)))
    rows = rows.where(F.coalesce("r1.baseline", "r2.baseline", "r3.baseline") > 0)
    actual = {r: F.col(f"r{r}.actual") for r in (1, 2, 3)}
    lift = {r: (F.col(f"r{r}.actual") - F.col(f"r{r}.baseline")) * 100 for r in (1, 2, 3)}
    beats = {r: F.col(f"r{r}.actual") > F.col(f"r{r}.baseline") for r in (1, 2, 3)}
    one = lambda c: F.when(c, 1).otherwise(0)
    there = {r: one(F.col(f"r{r}").isNotNull()) for r in (1, 2, 3)}
    n = there[1] + there[2] + there[3]
    pairs = [(1, 2), (1, 3), (2, 3)]
    both = {p: F.col(f"r{p[0]}").isNotNull() & F.col(f"r{p[1]}").isNotNull() for p in pairs}
    tie = {p: both[p] & _tied(actual[p[0]], actual[p[1]]) for p in pairs}
    count = lambda cs: sum((one(F.coalesce(c, F.lit(False))) for c in cs), F.lit(0))
    strict = F.col("r1").isNotNull()
    for r in (2, 3):
        strict = strict & (F.col(f"r{r}").isNull() | ((actual[1] > actual[r]) & ~_tied(actual[1], actual[r])))
    best = F.greatest(*(F.coalesce(actual[r], F.lit(float("-inf"))) for r in (1, 2, 3)))
    rows = rows.select(
        "*", n.alias("n"), count(beats.values()).alias("n_beats"), F.least(*lift.values()).alias("worst"), count(tie.values()).alias("tied"),
        count([both[p] & (actual[p[0]] > actual[p[1]]) & ~tie[p] for p in pairs]).alias("concordant"), count([both[p] & (actual[p[0]] < actual[p[1]]) & ~tie[p] for p in pairs]).alias("discordant"),
        one(F.coalesce(strict, F.lit(False))).alias("strict"), one(F.coalesce(_tied(actual[1], best), F.lit(False))).alias("level"),
    )
    directed, many = F.col("concordant") + F.col("discordant") > 0, F.col("n") >= 2
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = rows.agg(
        F.count(F.lit(1)).alias("scenarios"), total("n").alias("candidates"), total("n_beats").alias("beating"), F.sum(sum((F.coalesce(lift[r], F.lit(0.0)) for r in lift), F.lit(0.0))).alias("_lift"),
        F.count_if(F.col("n_beats") > 0).alias("any_beat"), F.count_if(F.col("n_beats") == F.col("n")).alias("all_beat"), F.coalesce(F.avg("worst"), F.lit(0.0)).alias("mean_worst_lift_pp"),
        F.count_if(many).alias("multi"), F.count_if(F.col("n") == 3).alias("three"), F.count_if(directed).alias("comparable"), F.count_if(directed & (F.col("strict") == 1)).alias("rank_one_best"), F.count_if(many & (F.col("level") == 1) & ~(directed & (F.col("strict") == 1))).alias("rank_one_tied"),
        total("concordant").alias("concordant"), total("discordant").alias("discordant"), total("tied").alias("tied"), F.coalesce(F.avg((actual[1] - actual[2]) * 100), F.lit(0.0)).alias("mean_one_minus_two_pp"),
        *(f for r in (1, 2, 3) for f in (F.count(f"r{r}").alias(f"rank_{r}"), F.count_if(beats[r]).alias(f"rank_{r}_beating"), F.avg(lift[r]).alias(f"rank_{r}_mean_lift_pp"))),
    )
    c = F.col
    rate = lambda a, b: F.when(b > 0, a / b)
    return sums.select(
        "scenarios", "candidates", "beating", rate(c("_lift"), c("candidates")).alias("mean_lift_pp"), rate(c("beating"), c("candidates")).alias("beating_rate"), rate(c("any_beat"), c("scenarios")).alias("any_beat_rate"), rate(c("all_beat"), c("scenarios")).alias("all_beat_rate"),
        "mean_worst_lift_pp", "multi", "three", "comparable", rate(c("comparable"), c("scenarios")).alias("comparable_rate"), rate(c("rank_one_best"), c("comparable")).alias("rank_one_best_rate"), rate(c("rank_one_tied"), c("multi")).alias("rank_one_tied_rate"),
        "concordant", "discordant", "tied", rate(c("concordant"), c("concordant") + c("discordant")).alias("pair_accuracy"), rate(c("tied"), c("concordant") + c("discordant") + c("tied")).alias("tie_rate"), "mean_one_minus_two_pp",
        *(f for r in (1, 2, 3) for f in (c(f"rank_{r}"), rate(c(f"rank_{r}"), c("scenarios")).alias(f"rank_{r}_coverage"), rate(c(f"rank_{r}_beating"), c(f"rank_{r}")).alias(f"rank_{r}_beating_rate"), c(f"rank_{r}_mean_lift_pp"))),
    )
