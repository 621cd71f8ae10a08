"""Vectors, profiles, evaluation, uplift and backtest queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket
from ..functions.safe import product_round6, ratio6
from ..operators import backtest, beam, evaluation, features, profiles, ranking, uplift
from ..operators.predicates import is_event
from ..sources.event_log import raw_events, typed
from .audience import END, scoped, with_raw
from .sql import RAW

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def rounded(column: str):
    return F.transform(column, lambda x: F.round(x, 6))


# Vectors


def _v2_sql() -> str:
    kinds = {"page": "page_view", "search": "hotel_search", "click": "hotel_click", "detail": "hotel_detail_view", "start": "booking_start", "complete": "booking_complete", "cancel": "booking_cancel", "impression": "promotion_impression", "promo": "promotion_click", "redirect": "campaign_redirect_click", "landing": "campaign_landing"}
    counts = [f"count(*) FILTER (event_name = '{v}') AS {k}" for k, v in kinds.items()]
    extra = {
        "n": "count(*)", "deals": "count(*) FILTER (deal = '1')", "prices": "count(price)", "budget": "count(*) FILTER (price > 0 AND price < 150000)", "premium": "count(*) FILTER (price >= 300000)",
        "canc": "count(*) FILTER (free_cancellation = 1)", "brk": "count(*) FILTER (breakfast = 1)", "dests": "count(DISTINCT vector_destination) FILTER (vector_destination <> '')", "checkins": "count(checkin)",
        "spring": "count(*) FILTER (month(checkin) IN (3,4,5))", "summer": "count(*) FILTER (month(checkin) IN (6,7,8))", "fall": "count(*) FILTER (month(checkin) IN (9,10,11))", "winter": "count(*) FILTER (month(checkin) IN (12,1,2))",
        "l7": "count(*) FILTER (lead BETWEEN 0 AND 7)", "l30": "count(*) FILTER (lead BETWEEN 8 AND 30)", "l99": "count(*) FILTER (lead > 30)", "wk": "count(*) FILTER (isodow(checkin) IN (6,7))",
        "search_at": "max(event_time) FILTER (event_name = 'hotel_search')", "detail_at": "max(event_time) FILTER (event_name = 'hotel_detail_view')", "start_at": "max(event_time) FILTER (event_name = 'booking_start')",
        "resp_at": "max(event_time) FILTER (event_name IN ('promotion_click', 'campaign_landing'))", "deal_at": "max(event_time) FILTER (deal = '1')",
    }
    counts += [f"{v} AS {k}" for k, v in extra.items()]
    counts += [f"coalesce(sum(sgn) FILTER (vector_destination <> '' AND bkt = {i}), 0) AS b{i}" for i in range(16)]
    inten = lambda x: f"least(1.0, ln(1.0 + {x}) / ln(1.0 + n))"
    rec = lambda x: f"coalesce(exp(-datediff('day', {x}::date, DATE '2024-01-25') / 30.0), 0)"
    smooth = lambda a, b: f"({a} + 1.0) / ({b} + 10.0)"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    gone = '"start" > complete AND "start" > 0'
    terms = [inten(k if k != "start" else '"start"') for k in ("page", "search", "click", "detail", "start", "complete", "cancel")]
    terms += [rec(x) for x in ("search_at", "detail_at", "start_at")]
    terms += [smooth("click", "search"), smooth("detail", "click"), smooth('"start"', "detail"), smooth("complete", '"start"'), flag(gone), inten("(detail + click)")]
    terms += [f"b{i} / n" for i in range(16)]
    terms += [share(k, "checkins") for k in ("spring", "summer", "fall", "winter", "l7", "l30", "l99", "wk")]
    terms += [inten("deals"), rec("deal_at"), inten("prices"), share("budget", "prices"), share("premium", "prices"), inten("canc"), inten("brk"), f"least(1.0, ({flag('deals > 0')} + {flag('canc > 0')} + {flag('brk > 0')}) / 3.0)"]
    terms += [inten(k) for k in ("impression", "promo", "redirect", "landing")]
    terms += [smooth("promo", "impression"), smooth("landing", "promo"), rec("resp_at"), inten("(promo + landing)")]
    recent = "greatest(" + ", ".join(f"coalesce({x}, TIMESTAMP '1970-01-01')" for x in ("search_at", "detail_at", "start_at", "resp_at")) + ")"
    terms += [flag("search + click + detail > 0"), flag("dests = 1"), "least(1.0, dests / 3.0)", flag(gone), flag("promo + landing > 0"), flag("deals + canc + brk > 0"), flag(f"datediff('day', {recent}::date, DATE '2024-01-25') <= 30")]
    terms += [f"least(1.0, CASE WHEN detail + click >= 2 THEN 0.34 ELSE 0 END + CASE WHEN {gone} THEN 0.33 ELSE 0 END + CASE WHEN promo + landing > 0 THEN 0.33 ELSE 0 END)"]
    array = ", ".join(f"({t})::double" for t in terms)
    return f"""WITH {RAW},
x AS (SELECT *, datediff('day', event_time::date, checkin) AS lead, (('0x' || substr(sha256(vector_destination), 16, 1))::int) AS bkt,
        CASE WHEN ('0x' || substr(sha256(vector_destination), 17, 2))::int % 2 = 1 THEN -1.0 ELSE 1.0 END AS sgn FROM w),
u AS (SELECT user_id, {", ".join(counts)} FROM x GROUP BY user_id),
v AS (SELECT user_id, [{array}] AS r FROM u)
SELECT user_id, list_transform(r, lambda z: round(z / sqrt(list_dot_product(r, r)), 6)) AS behavior_vector FROM v"""


@query("behavior_vector_v2", _v2_sql())
def behavior_vector_v2(spark, sf_dir):
    return features.behavior_vector_v2(scoped(spark, sf_dir), END).select("user_id", rounded("behavior_vector").alias("behavior_vector"))


_B = lambda c, n, i: f"('0x' || substr(sha256({c}), 1, 16))::UBIGINT % {n} = {i}"


def _v1_sql() -> str:
    share = lambda c: f"count(*) FILTER ({c}) / count(*)"
    names = ", ".join(f"'{e}'" for e in features.V1_EVENTS)
    terms = [share(f"event_name = '{e}'") for e in features.V1_EVENTS] + [share(f"event_name NOT IN ({names})")]
    terms += [share(_B(c, n, i)) for c, n in (("source", 4), ("hotel_cluster", 16), ("hotel_market", 16), ("page_path", 8)) for i in range(n)]
    terms += [share("event_name IN ('promotion_click', 'campaign_landing', 'campaign_redirect_click', 'promotion_impression')"), share("true"), share("true"), share("free_cancellation = 1"), share("breakfast = 1"), "coalesce(avg(least(greatest(price / 1000000.0, 0), 1)) FILTER (price IS NOT NULL), 0)"]
    rate = lambda a, b: f"CASE WHEN count(*) FILTER (event_name = '{b}') > 0 THEN count(*) FILTER (event_name = '{a}') / count(*) FILTER (event_name = '{b}') ELSE 0 END"
    terms += [rate("booking_complete", "booking_start"), rate("promotion_click", "promotion_impression")]
    return with_raw(f"SELECT user_id, list_transform([{', '.join(f'({t})::double' for t in terms)}], lambda z: round(z, 6)) AS behavior_vector FROM w GROUP BY user_id")


@query("behavior_vector_v1", _v1_sql())
def behavior_vector_v1(spark, sf_dir):
    """Prices are added in the order of the files, as the SQL's ``avg`` does on one thread: a mean may lie on the half of the last decimal."""
    return features.behavior_vector_v1(scoped(spark, sf_dir, placed=True), "_at").select("user_id", F.transform("behavior_vector", product_round6).alias("behavior_vector"))


@query("signed_hash_buckets", with_raw("SELECT user_id, " + ", ".join(f"coalesce(sum(CASE WHEN ('0x' || substr(sha256(vector_destination), 17, 2))::int % 2 = 1 THEN -1.0 ELSE 1.0 END) FILTER (vector_destination <> '' AND ('0x' || substr(sha256(vector_destination), 16, 1))::int = {i}), 0)::double AS b{i}" for i in range(16)) + " FROM w GROUP BY user_id"))
def signed_hash_buckets(spark, sf_dir):
    from ..functions.hashing import signed_coordinate

    rows = scoped(spark, sf_dir).withColumn("d", features.vector_destination())
    bucket, sign = signed_coordinate(F.col("d"))
    rows = rows.withColumn("b", bucket).withColumn("s", sign)
    return rows.groupBy("user_id").agg(*(F.sum(F.when((F.col("d") != "") & (F.col("b") == i), F.col("s")).otherwise(0.0)).alias(f"b{i}") for i in range(16)))


@query("bucket_histogram", with_raw("SELECT user_id, " + ", ".join(f"count(*) FILTER ({_B('hotel_market', 8, i)}) AS m{i}" for i in range(8)) + " FROM w GROUP BY user_id"))
def bucket_histogram(spark, sf_dir):
    rows = scoped(spark, sf_dir).withColumn("b", stable_bucket(F.col("hotel_market"), 8))
    return rows.groupBy("user_id").agg(*(F.count_if(F.col("b") == i).alias(f"m{i}") for i in range(8)))


# Profiles

TERMS, MONTHS = ["jeju", "제주"], [1, 2]
_MATCH = "(contains(destination_text, 'jeju') OR contains(destination_text, '제주'))"
_COUNTS = ", ".join(f"count(*) FILTER (event_name = '{e}') AS {e}_count" for e in profiles.COUNTED)
_PROFILE = f"""SELECT user_id, count(*) AS event_count, {_COUNTS},
  count(*) FILTER (deal <> '') AS deal_event_count, count(*) FILTER (free_cancellation = 1) AS free_cancellation_count,
  count(*) FILTER (breakfast = 1) AS breakfast_included_count, count(price) AS price_event_count, avg(price) AS avg_price,
  list_sort(list(DISTINCT hotel_market))[1:20] AS hotel_market_values, count(DISTINCT destination_id || ' ' || destination_name) AS n_destinations,
  count(DISTINCT hotel_market) AS n_markets, count(DISTINCT hotel_cluster) AS n_clusters, any_value(age_group) AS age, any_value(gender) AS gender,
  count(*) FILTER ({_MATCH}) AS destination_match_count, count(*) FILTER (month(checkin) IN (1, 2)) AS season_match_count,
  count(*) FILTER (event_name = 'hotel_search' AND {_MATCH} AND month(checkin) IN (1, 2)) AS promotion_condition_search_count,
  count(*) FILTER (event_name = 'hotel_search' AND deal = 'true') AS deal_search_count FROM w GROUP BY user_id"""


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.user_signals(scoped(spark, sf_dir), TERMS, MONTHS)


_SHOWN = ["event_count", *(f"{e}_count" for e in profiles.COUNTED), "deal_event_count", "free_cancellation_count", "breakfast_included_count", "price_event_count", "hotel_market_values", "destination_match_count", "season_match_count", "promotion_condition_search_count", "deal_search_count"]


@query("user_signals", with_raw(f"SELECT user_id, {', '.join(_SHOWN)}, round(avg_price, 4) AS avg_price FROM ({_PROFILE})"))
def user_signals(spark, sf_dir):
    return user_profiles(spark, sf_dir).select("user_id", *_SHOWN, F.round("avg_price", 4).alias("avg_price"))


@query("exclude_behaviors", with_raw(f"SELECT user_id FROM ({_PROFILE}) WHERE booking_complete_count = 0 AND campaign_landing_count = 0 AND promotion_click_count = 0 AND campaign_redirect_click_count = 0"))
def exclude_behaviors(spark, sf_dir):
    return user_profiles(spark, sf_dir).where(~profiles.excluded(["booking_complete", "promotion_response"])).select("user_id")


@query("demographic_filter", with_raw(f"SELECT user_id FROM ({_PROFILE}) WHERE age IN ('20s', '30s') AND gender = 'female'"))
def demographic_filter(spark, sf_dir):
    return user_profiles(spark, sf_dir).where(profiles.demographic(["20s", "30s"], ["female"])).select("user_id")


_CANDIDATE = {
    "intent_matched": "hotel_search_count + hotel_detail_view_count > 0 AND destination_match_count > 0 AND season_match_count > 0",
    "target_destination_affinity": "destination_match_count >= 2 AND hotel_search_count + hotel_detail_view_count > 0",
    "funnel_recovery": "booking_start_count > booking_complete_count AND destination_match_count > 0",
    "promotion_responsive": "promotion_click_count > 0 OR campaign_landing_count > 0 OR (promotion_impression_count > 0 AND promotion_click_count / promotion_impression_count >= 0.15)",
    "general_destination_explorer": "(n_destinations >= 2 OR n_markets >= 2 OR n_clusters >= 2) AND hotel_search_count + hotel_detail_view_count > 0",
    "benefit_value_seeker": "deal_event_count + free_cancellation_count + breakfast_included_count + price_event_count > 0 AND destination_match_count > 0",
}


def _candidate(kind: str) -> None:
    @query(f"candidate_{kind}", with_raw(f"SELECT user_id FROM ({_PROFILE}) WHERE {_CANDIDATE[kind]}"))
    def run(spark, sf_dir):
        return user_profiles(spark, sf_dir).where(profiles.candidate(kind, True, True)).select("user_id")


for _kind in profiles.CANDIDATES:
    _candidate(_kind)


@query("baseline_metrics", with_raw("SELECT " + ", ".join(f"round(avg({k}_count), 6) AS {k}, round(avg(({k}_count > 0)::int), 6) AS {k}_user_rate" for k in ("hotel_search", "hotel_detail_view", "promotion_click", "campaign_landing", "booking_start", "booking_complete", "destination_match")) + f" FROM ({_PROFILE})"))
def baseline_metrics(spark, sf_dir):
    found = profiles.baseline_metrics(user_profiles(spark, sf_dir))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("beam_candidates", with_raw("SELECT name, users, successes FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER ({c}) AS users, count(*) FILTER (({c}) AND booking_complete_count > 1) AS successes FROM ({_PROFILE})" for k, c in _CANDIDATE.items()) + ")"))
def beam_candidates(spark, sf_dir):
    conditions = {k: profiles.candidate(k, True, True) for k in profiles.CANDIDATES}
    return profiles.candidate_sizes(user_profiles(spark, sf_dir), conditions, profiles.n("booking_complete") > 1)


_SHOWN_BY = {"destination_repeat_search": "destination_match_count", "hotel_detail_view": "hotel_detail_view_count", "booking_start": "booking_start_count", "booking_start_without_complete": "booking_start_count", "price_compare": "price_event_count", "discount_interest": "deal_search_count", "free_cancellation_interest": "fc_search_count", "breakfast_interest": "breakfast_included_count", "promotion_click": "promotion_click_count", "campaign_landing": "campaign_landing_count"}
_BEAM = " UNION ALL ".join(
    f"SELECT 'beam_{k}_{least}' AS name, {beam.INTENT[dim] + (0.05 if k == beam.UNFINISHED else 0)} AS intent, {0.8 if dim in beam.ALIGNED else 0.7} AS aligned, count(*) AS users, avg((hotel_detail_view_count > 0)::int) AS d, avg((booking_start_count > 0)::int) AS s, avg((booking_complete_count > 0)::int) AS c FROM p WHERE promotion_condition_search_count > 0 AND {_SHOWN_BY[k]} >= {least}" + (" AND booking_complete_count = 0" if k == beam.UNFINISHED else "")
    for k, (dim, _, options) in beam.BEHAVIOURS.items()
    for least in options
)


@query(
    "beam_scored",
    with_raw(
        f"SELECT name, users, round(0.22 * aligned + 0.18 * least(intent, 1.0) + 0.14 * least(users / 15.0, 1.0) + 0.24 * (0.35 * d + 0.45 * s + 0.2 * c) + 0.1 * sqrt(users / total) + 0.12 * (1 - users / total) - 0.15 * greatest((10 - users) / 10.0, 0.0), 6) AS score FROM (WITH p AS (SELECT q.*, f.fc_search_count FROM ({_PROFILE}) q JOIN (SELECT user_id, count(*) FILTER (event_name = 'hotel_search' AND free_cancellation = 1) AS fc_search_count FROM w GROUP BY user_id) f USING (user_id)) SELECT *, (SELECT count(*) FROM p) AS total FROM ({_BEAM})) WHERE users > 0"
    ),
)
def beam_scored(spark, sf_dir):
    """All first-level audiences of a promotion with a destination and a season, scored."""
    p = user_profiles(spark, sf_dir)
    base = beam.anchor(p, beam.Demand(destination=True, season=True), 1)
    level = [((k, least),) for k, (_, _, options) in beam.BEHAVIOURS.items() for least in options]
    found = [(c.name, c.users, round(c.score, 6)) for c in (beam.scored(p, base, level, (), 5) if base else []) if c.users]
    return spark.createDataFrame(found, "name string, users long, score double")


@query("beam_audiences")
def beam_audiences(spark, sf_dir):
    """The audiences that the whole search selects."""
    found = beam.search(user_profiles(spark, sf_dir), beam.Demand(destination=True, season=True), 5)
    return spark.createDataFrame([(c.name, c.users, round(c.score, 6)) for c in found.selected], "name string, users long, score double")


@query("smoothed_rate", with_raw(f"SELECT g, round((s + 0.5 + 30 * b) / (n + 31), 6) AS rate FROM (SELECT hotel_search_count % 4 AS g, count(*) AS n, count(*) FILTER (booking_complete_count > 5) AS s FROM ({_PROFILE}) GROUP BY g), (SELECT avg((booking_complete_count > 5)::int) AS b FROM ({_PROFILE}))"))
def smoothed_rate(spark, sf_dir):
    p = user_profiles(spark, sf_dir).select((profiles.n("hotel_search") % 4).alias("g"), (profiles.n("booking_complete") > 5).alias("won"))
    base = p.agg(F.avg(F.col("won").cast("double")).alias("b"))
    groups = p.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.count_if("won").alias("s"))
    return groups.join(F.broadcast(base)).select("g", F.round(profiles.smoothed_rate(F.col("s"), F.col("size"), F.col("b")), 6).alias("rate"))


_METRIC = {k: "deal_event_count + free_cancellation_count + breakfast_included_count + price_event_count" if v == "benefit" else f"{v}_count" for k, v in profiles.LIFT_METRIC.items()}


@query(
    "candidate_scores",
    with_raw(
        "SELECT name, users, round(0.15 * m + 0.70 * e + 0.06 * l + 0.06 * r + 0.03, 6) AS score, round(l, 6) AS behavior_lift_vs_baseline, round(e, 6) AS expected_goal_performance, CASE WHEN r < 0.75 THEN 'small_high_intent' ELSE 'primary' END AS tier FROM (SELECT name, users, users / total AS m, CASE WHEN users = 0 THEN rate ELSE (won + 0.5 + 30 * rate) / (users + 31) END AS e, CASE WHEN everyone <= 0 THEN CASE WHEN metric > 0 THEN 1.0 ELSE 0.5 END ELSE least(metric / greatest(users, 1) / (everyone * 2), 1.0) END AS l, least(users / 90.0, 1.0) AS r FROM ("
        + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) FILTER ({c}) AS users, count(*) AS total, count(*) FILTER (({c}) AND booking_complete_count > 1) AS won, count(*) FILTER (booking_complete_count > 1) / count(*) AS rate, coalesce(sum({_METRIC[k]}) FILTER ({c}), 0) AS metric, avg({_METRIC[k]}) AS everyone FROM ({_PROFILE})" for k, c in _CANDIDATE.items())
        + "))"
    ),
)
def candidate_scores(spark, sf_dir):
    conditions = {k: profiles.candidate(k, True, True) for k in profiles.CANDIDATES}
    found = profiles.score_candidates(user_profiles(spark, sf_dir), conditions, profiles.n("booking_complete") > 1, 30)
    return found.select("name", "users", *(F.round(c, 6).alias(c) for c in ("score", "behavior_lift_vs_baseline", "expected_goal_performance")), "tier")


@query("marketing_profiles", "SELECT c_mktsegment, count(*) AS event_count, count(*) FILTER (o_orderstatus = 'F') AS booking_count, round(avg(o_totalprice), 4) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def marketing_profiles(spark, sf_dir):
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("o_orderstatus") == "F").alias("booking_count"), F.round(F.avg("o_totalprice"), 4).alias("avg_price"))


@query("ratio_eval", "SELECT ratio, count(*) FILTER (r <= ceil(n * ratio)) AS selected, round(avg(y) FILTER (r <= ceil(n * ratio)), 6) AS rate, round(avg(y) FILTER (r <= ceil(n * ratio)) - avg(y), 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n, (c_custkey % 3 = 0)::int AS y FROM customer), (SELECT unnest([0.2::double, 0.5::double, 0.8::double]) AS ratio) GROUP BY ratio")
def ratio_eval(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("y", F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0))
    found = profiles.ratio_evaluation(c, "c_mktsegment", "c_acctbal", "y", "c_custkey", [0.2, 0.5, 0.8])
    return found.select("ratio", "selected", F.round("rate", 6).alias("rate"), F.round("lift", 6).alias("lift"))


# Evaluation: touches and bookings are projections of the event log

CUTOFF = datetime(2024, 1, 28)
_T = "t AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'r' || (event_id % 40) END AS redirect_id FROM raw WHERE event_name IN ('promotion_click', 'campaign_landing', 'campaign_redirect_click'))"
_CUT = "TIMESTAMP '2024-01-28'"


def touches(spark, sf_dir):
    t = typed(raw_events(spark, sf_dir)).where(is_event("promotion_click", "campaign_landing", "campaign_redirect_click"))
    return t.withColumn("redirect_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("r"), (F.col("event_id") % 40).cast("string"))))


def bookings(spark, sf_dir):
    b = typed(raw_events(spark, sf_dir)).where(is_event("booking_start", "booking_complete"))
    return b.withColumn("revenue", F.when(F.col("price") != "", F.col("price").cast("double")))


@query("inflow_rate", f"WITH {RAW}, {_T}, c AS (SELECT ad_experiment_id, count(DISTINCT k) FILTER (event_name = 'campaign_landing') AS numerator, count(DISTINCT k) FILTER (event_name = 'campaign_redirect_click') AS denominator FROM (SELECT *, coalesce('redirect:' || redirect_id, 'user:' || user_id) AS k FROM t WHERE event_name <> 'promotion_click' AND event_time <= {_CUT}) GROUP BY ad_experiment_id) SELECT *, round(numerator / nullif(denominator, 0), 6) AS rate FROM c")
def inflow_rate(spark, sf_dir):
    return evaluation.inflow(touches(spark, sf_dir), CUTOFF).withColumn("rate", ratio6(F.col("numerator"), F.col("denominator")))


_FUNNEL = f"""WITH {RAW}, {_T},
r AS (SELECT ad_experiment_id, user_id, min(event_time) AS response_at, max((source = 'fixture')::int) AS fx FROM t WHERE event_name = 'promotion_click' AND event_time <= {_CUT} GROUP BY ALL),
b AS (SELECT ad_experiment_id, user_id, max(event_time) AS s, max(event_time) FILTER (event_name = 'hotel_detail_view') AS d FROM raw WHERE validation_status = 'valid' AND event_name IN ('hotel_search', 'hotel_click', 'hotel_detail_view') AND event_time <= {_CUT} GROUP BY ALL),
k AS (SELECT ad_experiment_id, user_id, max(event_time) FILTER (event_name = 'booking_start') AS st, max(event_time) FILTER (event_name = 'booking_complete') AS c FROM raw WHERE event_name IN ('booking_start', 'booking_complete') AND event_time <= {_CUT} GROUP BY ALL),
p AS (SELECT r.*, coalesce(s, TIMESTAMP '1970-01-01') AS s, coalesce(d, TIMESTAMP '1970-01-01') AS d, coalesce(st, TIMESTAMP '1970-01-01') AS st, coalesce(c, TIMESTAMP '1970-01-01') AS c FROM r LEFT JOIN b USING (ad_experiment_id, user_id) LEFT JOIN k USING (ad_experiment_id, user_id)),
f AS (SELECT ad_experiment_id, count(*) AS response_count, count(*) FILTER (greatest(s, d, st, c) >= response_at) AS hotel_search_count, count(*) FILTER (greatest(d, st, c) >= response_at) AS hotel_detail_view_count,
  count(*) FILTER (greatest(st, c) >= response_at) AS booking_start_count, count(*) FILTER (c >= response_at) AS booking_complete_count, count(*) FILTER (fx = 1) AS fixture_response_count FROM p GROUP BY ad_experiment_id)"""


def _funnel(spark, sf_dir):
    valid = typed(raw_events(spark, sf_dir)).where("validation_status = 'valid'")
    return evaluation.funnel(touches(spark, sf_dir), valid, bookings(spark, sf_dir), "promotion_click", CUTOFF)


@query("funnel_conversion", f"{_FUNNEL} SELECT * FROM f")
def funnel_conversion(spark, sf_dir):
    return _funnel(spark, sf_dir)


_STAGES = ("response_count", "hotel_search_count", "hotel_detail_view_count", "booking_start_count", "booking_complete_count")


@query("funnel_dropoff", f"{_FUNNEL}, s AS (" + " UNION ALL ".join(f"SELECT ad_experiment_id, {i} AS stage, {c} AS users FROM f" for i, c in enumerate(_STAGES)) + "), l AS (SELECT *, lag(users) OVER (PARTITION BY ad_experiment_id ORDER BY stage) AS b FROM s) SELECT ad_experiment_id, stage, users, CASE WHEN b IS NOT NULL THEN coalesce(round(users / nullif(b, 0), 6), 0) END AS conversion_rate, CASE WHEN b IS NOT NULL THEN greatest(b - users, 0) END AS dropoff_count, CASE WHEN b IS NOT NULL THEN coalesce(round(greatest(b - users, 0) / nullif(b, 0), 6), 0) END AS dropoff_rate FROM l")
def funnel_dropoff(spark, sf_dir):
    rows = _funnel(spark, sf_dir).select("ad_experiment_id", F.posexplode(F.array(*_STAGES)).alias("stage", "users"))
    return evaluation.dropoff(rows, "ad_experiment_id", "stage", "users")


_DAY = 5
_COHORT = f"""WITH {RAW}, {_T},
r AS (SELECT ad_experiment_id, user_id, min(event_time) AS response_at FROM t WHERE event_name = 'promotion_click' AND event_time <= {_CUT} GROUP BY ALL),
e AS (SELECT * FROM raw WHERE validation_status = 'valid'),
v AS (SELECT r.user_id, count(e.event_id) AS views FROM r LEFT JOIN e ON e.user_id = r.user_id AND e.event_name = 'hotel_detail_view' AND e.event_time < response_at AND e.event_time >= response_at - INTERVAL {_DAY} DAY GROUP BY r.user_id),
j AS (SELECT r.user_id, max(event_time) FILTER (event_name = 'booking_start') AS s, max(event_time) FILTER (event_name = 'booking_complete') AS c, arg_max(price, event_time) FILTER (event_name = 'booking_start' AND price IS NOT NULL) AS rev
  FROM r LEFT JOIN raw b ON b.user_id = r.user_id AND b.ad_experiment_id = r.ad_experiment_id AND b.event_name IN ('booking_start', 'booking_complete') AND b.event_time >= response_at AND b.event_time <= {_CUT} GROUP BY r.user_id),
p AS (SELECT r.user_id, arg_max(price, event_time) AS nightly FROM r JOIN e ON e.user_id = r.user_id AND e.event_name = 'booking_start' AND e.event_time >= response_at AND e.event_time <= {_CUT} AND price IS NOT NULL GROUP BY r.user_id),
u AS (SELECT r.ad_experiment_id, views, s, c, rev, nightly FROM r LEFT JOIN v USING (user_id) LEFT JOIN j USING (user_id) LEFT JOIN p USING (user_id))"""


@query(
    "booking_intent_cohorts",
    f"""{_COHORT} SELECT ad_experiment_id, count(*) FILTER (views >= 2) AS repeat_view_user_count, count(*) FILTER (views >= 2 AND c IS NOT NULL AND c >= coalesce(s, TIMESTAMP '1970-01-01')) AS repeat_view_booking_count,
  count(*) FILTER (views < 2) AS comparison_user_count, count(*) FILTER (views < 2 AND c IS NOT NULL AND c >= coalesce(s, TIMESTAMP '1970-01-01')) AS comparison_booking_count,
  count(*) FILTER (s IS NOT NULL AND c IS NULL) AS booking_abandon_user_count, count(c) AS booking_complete_user_count,
  count(*) FILTER (s IS NOT NULL AND nightly > 200000) AS high_price_booking_start_user_count, count(*) FILTER (s IS NOT NULL AND c IS NULL AND nightly > 200000) AS high_price_booking_abandon_user_count,
  count(*) FILTER (c IS NOT NULL AND nightly > 200000) AS high_price_booking_complete_user_count,
  quantile_disc(rev, 0.5) FILTER (s IS NOT NULL AND c IS NULL) AS booking_abandon_median_revenue, quantile_disc(rev, 0.5) FILTER (c IS NOT NULL) AS booking_complete_median_revenue,
  quantile_disc(nightly, 0.5) FILTER (s IS NOT NULL AND c IS NULL) AS booking_abandon_median_nightly_price, quantile_disc(nightly, 0.5) FILTER (c IS NOT NULL) AS booking_complete_median_nightly_price
  FROM u GROUP BY ad_experiment_id""",
)
def booking_intent_cohorts(spark, sf_dir):
    valid = typed(raw_events(spark, sf_dir)).where("validation_status = 'valid'")
    return evaluation.booking_intent_cohorts(touches(spark, sf_dir), valid, bookings(spark, sf_dir), "promotion_click", CUTOFF, _DAY)


@query("interval_join_pre_behavior", f"{_COHORT} SELECT user_id, views FROM v")
def interval_join_pre_behavior(spark, sf_dir):
    from ..operators.intervals import days_before

    first = evaluation.responses(touches(spark, sf_dir), "promotion_click", CUTOFF)
    seen = typed(raw_events(spark, sf_dir)).where("validation_status = 'valid' AND event_name = 'hotel_detail_view'")
    return days_before(first, seen, "user_id", "response_at", "event_time", _DAY).groupBy(F.col("a.user_id").alias("user_id")).agg(F.count("e.event_id").alias("views"))


@query("interval_join_post_outcome", f"{_COHORT} SELECT user_id, s IS NOT NULL AS started, c IS NOT NULL AS completed FROM j")
def interval_join_post_outcome(spark, sf_dir):
    from ..operators.intervals import until
    from ..sources.event_log import instant

    first = evaluation.responses(touches(spark, sf_dir), "promotion_click", CUTOFF)
    j = until(first, bookings(spark, sf_dir), "user_id", "response_at", "event_time", instant(CUTOFF))
    any_ = lambda n: F.coalesce(F.bool_or(F.col("e.event_name") == n), F.lit(False))
    return j.groupBy(F.col("a.user_id").alias("user_id")).agg(any_("booking_start").alias("started"), any_("booking_complete").alias("completed"))


@query("cohort_median", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS median_price FROM orders GROUP BY o_orderstatus")
def cohort_median(spark, sf_dir):
    return ranking.lower_median(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderstatus"], "o_totalprice").withColumnRenamed("median", "median_price")


_STATUS = f"{_FUNNEL}, g AS (SELECT *, CASE WHEN response_count < 12 THEN 'insufficient_data' WHEN round(booking_complete_count / response_count, 6) >= 0.9 THEN 'goal_met' ELSE 'goal_not_met' END AS status, CASE WHEN response_count < 12 THEN 'insufficient' WHEN response_count < 100 THEN 'limited' ELSE 'sufficient' END AS evidence FROM f)"


def _statuses(spark, sf_dir):
    f = _funnel(spark, sf_dir)
    n = F.col("response_count")
    status = evaluation.goal_status(ratio6(F.col("booking_complete_count"), n), F.lit(0.9), n, n, 12)
    return f.withColumn("status", status).withColumn("evidence", evaluation.evidence_strength(n, 12))


@query("goal_status", f"{_STATUS} SELECT ad_experiment_id, status, evidence FROM g")
def goal_status(spark, sf_dir):
    return _statuses(spark, sf_dir).select("ad_experiment_id", "status", "evidence")


@query("run_aggregate_status", f"{_STATUS} SELECT 'run1' AS run, count(*) AS segments, CASE WHEN bool_and(status = 'goal_met') THEN 'goal_met' WHEN bool_and(status = 'insufficient_data') THEN 'insufficient_data' WHEN NOT bool_or(status = 'goal_met') AND bool_or(status = 'goal_not_met') THEN 'goal_not_met' ELSE 'partial_goal_met' END AS run_status FROM g")
def run_aggregate_status(spark, sf_dir):
    return evaluation.run_status(_statuses(spark, sf_dir).withColumn("run", F.lit("run1")), "run")


# Uplift: units are customers, outcomes their orders

_UNITS = "SELECT c_custkey AS unit, c_acctbal AS score, c_mktsegment AS experiment, (c_custkey % 3 = 0)::int AS treatment, CASE c_custkey % 2 WHEN 0 THEN 0.4 ELSE 0.25 END::double AS probability, c_nationkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01') THEN 1 ELSE 0 END AS outcome FROM customer"


def _units(spark, sf_dir):
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    units = c.select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("experiment"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("treatment"), F.when(F.col("c_custkey") % 2 == 0, 0.4).otherwise(0.25).alias("probability"), "c_nationkey", at("1998-01-01").alias("start"), at("1999-01-01").alias("end"))
    outcomes = o.select(F.col("o_custkey").alias("unit"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return uplift.examples(units, outcomes, "unit", "unit", "start", "end", "at")


@query("uplift_examples", f"SELECT unit, treatment, outcome FROM ({_UNITS})")
def uplift_examples(spark, sf_dir):
    return _units(spark, sf_dir).select("unit", "treatment", "outcome")


@query("transformed_outcome", f"SELECT unit, round(outcome * (treatment - probability) / (probability * (1 - probability)), 6) + 0.0::double AS target FROM ({_UNITS})")
def transformed_outcome(spark, sf_dir):
    return _units(spark, sf_dir).select("unit", (F.round(uplift.transformed_outcome(F.col("outcome"), F.col("treatment"), F.col("probability")), 6) + F.lit(0.0)).alias("target"))


_IPW = "round(sum(wt * outcome) FILTER (treatment = 1) / sum(wt) FILTER (treatment = 1), 6) AS treatment_rate, round(sum(wt * outcome) FILTER (treatment = 0) / sum(wt) FILTER (treatment = 0), 6) AS control_rate"
_W = "CASE WHEN treatment = 1 THEN 1 / probability ELSE 1 / (1 - probability) END AS wt"


@query("ipw_ate", f"SELECT experiment, count(*) AS n, {_IPW} FROM (SELECT *, {_W} FROM ({_UNITS})) GROUP BY experiment")
def ipw_ate(spark, sf_dir):
    found = uplift.ipw_rates(_units(spark, sf_dir), ["experiment"])
    return found.select("experiment", "n", F.round("treatment_rate", 6).alias("treatment_rate"), F.round("control_rate", 6).alias("control_rate"))


_CURVE = f"SELECT unit, row_number() OVER w AS rank, sum(CASE WHEN treatment = 1 THEN 0.5 * outcome / probability ELSE -0.5 * outcome / (1 - probability) END) OVER (ORDER BY score DESC, unit ROWS UNBOUNDED PRECEDING) AS gain FROM ({_UNITS}) WINDOW w AS (ORDER BY score DESC, unit)"


@query("qini_curve", f"SELECT unit, rank, round(gain, 6) + 0.0::double AS gain FROM ({_CURVE})")
def qini_curve(spark, sf_dir):
    found = uplift.qini_curve(_units(spark, sf_dir), "score", "unit")
    return found.select("unit", F.col("rank").cast("long").alias("rank"), (F.round("gain", 6) + F.lit(0.0)).alias("gain"))


@query("qini_summary", f"SELECT count(*) AS n, round(avg(gain), 5) + 0.0::double AS auuc, round(arg_max(gain, rank) * avg(rank) / count(*), 5) + 0.0::double AS auuc_baseline, round(avg(gain) - arg_max(gain, rank) * avg(rank) / count(*), 5) + 0.0::double AS qini FROM ({_CURVE})")
def qini_summary(spark, sf_dir):
    found = uplift.qini_summary(uplift.qini_curve(_units(spark, sf_dir), "score", "unit"))
    return found.select("n", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("auuc", "auuc_baseline", "qini")))


@query("uplift_at_k", f"SELECT fraction, count(*) AS n, round(sum(wt * outcome) FILTER (treatment = 1) / sum(wt) FILTER (treatment = 1) - sum(wt * outcome) FILTER (treatment = 0) / sum(wt) FILTER (treatment = 0), 6) AS ate FROM (SELECT *, {_W}, row_number() OVER (ORDER BY score DESC, unit) AS r, count(*) OVER () AS total FROM ({_UNITS})), (SELECT unnest([0.1::double, 0.2::double, 0.3::double]) AS fraction) WHERE r <= greatest(1, ceil(total * fraction)) GROUP BY fraction")
def uplift_at_k(spark, sf_dir):
    found = uplift.uplift_at(_units(spark, sf_dir), "score", "unit", [0.1, 0.2, 0.3])
    return found.select("fraction", "n", F.round("ate", 6).alias("ate"))


@query("uplift_ridge")
def uplift_ridge(spark, sf_dir):
    rows = _units(spark, sf_dir).withColumn("target", uplift.transformed_outcome(F.col("outcome"), F.col("treatment"), F.col("probability")))
    model = uplift.fit_ridge(rows, ["score", "c_nationkey"], "target")
    return rows.select("unit", model.column([F.col("score"), F.col("c_nationkey")]).alias("cate"))


@query("time_split", "SELECT o_orderkey, p IN (SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY max(o_orderdate) DESC, o_orderpriority DESC LIMIT 1) AS is_test FROM (SELECT o_orderkey, o_orderpriority AS p FROM orders)")
def time_split(spark, sf_dir):
    return uplift.time_split(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate").select("o_orderkey", "is_test")


@query("stratified_split", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x' || substr(sha256(c_custkey::varchar), 1, 16))::UBIGINT, c_custkey) <= floor(count(*) OVER (PARTITION BY c_mktsegment) * 0.7) AS is_train FROM customer")
def stratified_split(spark, sf_dir):
    return uplift.stratified_split(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", ["c_mktsegment"]).select("c_custkey", "is_train")


# Hotel search rows, derived from orders

_WIDE = """SELECT o_orderkey AS row_id, o_orderdate AS date_time, o_custkey AS user_id, (o_orderstatus = 'F')::int AS is_booking, (o_orderkey % 6 + 1)::int AS cnt, (o_orderkey % 4 = 0)::int AS is_package, (o_orderkey % 3 = 0)::int AS is_mobile,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::date + (o_orderkey % 50)::int END AS srch_ci, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::date + (o_orderkey % 50 + o_orderkey % 6)::int END AS srch_co,
  (o_orderkey % 3 + 1)::int AS srch_adults_cnt, (o_orderkey % 5 = 0)::int AS srch_children_cnt, (CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END)::int AS srch_rm_cnt, (o_orderkey % 6)::int AS hotel_continent, (o_orderkey % 200)::int AS hotel_country, (o_orderkey % 300)::int AS hotel_market, (o_orderkey % 60)::int AS srch_destination_id FROM orders"""


def wide_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotel search rows by fixed rules from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    i = lambda c: c.cast("int")
    day = F.to_date("o_orderdate")
    return o.select(
        k.alias("row_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("date_time"), F.col("o_custkey").alias("user_id"), i(F.col("o_orderstatus") == "F").alias("is_booking"), i(k % 6 + 1).alias("cnt"), i(k % 4 == 0).alias("is_package"), i(k % 3 == 0).alias("is_mobile"),
        F.when(k % 9 != 0, F.date_add(day, i(k % 50))).alias("srch_ci"), F.when(k % 9 != 0, F.date_add(day, i(k % 50 + k % 6))).alias("srch_co"), i(k % 3 + 1).alias("srch_adults_cnt"), i(k % 5 == 0).alias("srch_children_cnt"), F.when(k % 7 == 0, 2).otherwise(1).alias("srch_rm_cnt"),
        i(k % 6).alias("hotel_continent"), i(k % 200).alias("hotel_country"), i(k % 300).alias("hotel_market"), i(k % 60).alias("srch_destination_id"),
    )


@query("event_explosion", f"SELECT row_id, event_name, \"offset\" FROM ({_WIDE}), (VALUES ('page_view', -2), ('hotel_search', 0), ('hotel_detail_view', 5), ('hotel_click', 10), ('booking_start', 20), ('booking_complete', 40)) AS s(event_name, \"offset\") WHERE event_name IN ('page_view', 'hotel_search', 'hotel_detail_view') OR (event_name = 'hotel_click' AND (cnt >= 2 OR is_booking = 1)) OR (event_name = 'booking_start' AND (is_booking = 1 OR cnt >= 4)) OR (event_name = 'booking_complete' AND is_booking = 1)")
def event_explosion(spark, sf_dir):
    return backtest.explode_events(wide_source(spark, sf_dir)).select("row_id", "event_name", "offset")


_DERIVED = f"SELECT *, CASE WHEN srch_ci IS NULL THEN 0 ELSE greatest(srch_co - srch_ci, 0) END AS nights, CASE WHEN srch_ci IS NULL THEN 0 ELSE greatest(srch_ci - date_time::date, 0) END AS lead FROM ({_WIDE})"


@query(
    "derived_rules",
    f"""SELECT row_id, CASE WHEN srch_rm_cnt >= 2 THEN 'multi_room' WHEN srch_children_cnt > 0 THEN 'family_room' WHEN srch_adults_cnt = 1 THEN 'single_room' ELSE 'standard_room' END AS room_type,
  CASE WHEN srch_children_cnt > 0 THEN 'family_travel' WHEN is_package = 1 THEN 'package_travel' WHEN srch_adults_cnt = 1 AND nights <= 2 THEN 'business_or_solo_travel' WHEN lead <= 7 THEN 'last_minute_travel' ELSE 'leisure_travel' END AS preferred_category,
  CASE WHEN is_package = 1 THEN 'package_bundle' WHEN lead >= 30 THEN 'early_booking' WHEN cnt >= 4 THEN 'comparison_deal' ELSE '' END AS deal, CASE WHEN lead >= 14 OR is_package = 1 THEN '1' ELSE '0' END AS free_cancellation,
  CASE WHEN is_package = 1 AND nights >= 2 THEN '1' ELSE '0' END AS breakfast_included,
  greatest(45000, 65000 + hotel_continent * 7000 + hotel_country % 80 * 900 + hotel_market % 120 * 450 + greatest(srch_rm_cnt, 1) * 22000 + greatest(srch_adults_cnt, 1) * 9000 + srch_children_cnt * 6000 + CASE WHEN is_package = 1 THEN -12000 ELSE 0 END + CASE WHEN lead <= 7 THEN 18000 ELSE 0 END)::bigint AS estimated_price FROM ({_DERIVED})""",
)
def derived_rules(spark, sf_dir):
    return backtest.derived(wide_source(spark, sf_dir)).select("row_id", "room_type", "preferred_category", "deal", "free_cancellation", "breakfast_included", "estimated_price")


@query("scenario_topn", f"SELECT srch_destination_id, count(DISTINCT user_id) AS users, count(*) AS n_rows FROM ({_WIDE}) WHERE srch_destination_id > 0 AND srch_destination_id NOT IN (5, 6) GROUP BY srch_destination_id HAVING count(DISTINCT user_id) >= 10 ORDER BY users DESC, n_rows DESC, srch_destination_id LIMIT 15")
def scenario_topn(spark, sf_dir):
    return backtest.scenarios(wide_source(spark, sf_dir), 10, 15, [5, 6])


@query("future_outcome", f"SELECT user_id, bool_or(srch_destination_id = 7 AND coalesce(month(srch_ci) IN (6, 7, 8), false)) AS contextual_booking FROM ({_WIDE}) WHERE is_booking = 1 GROUP BY user_id")
def future_outcome(spark, sf_dir):
    return backtest.future_outcome(wide_source(spark, sf_dir), 7, [6, 7, 8])


@query("booking_training_cells", f"SELECT is_mobile, is_package, stay_nights, days_until_checkin, count(*) AS event_count, count(*) FILTER (is_booking = 1) AS booking_count FROM (SELECT *, (CASE WHEN srch_ci IS NULL THEN 0 ELSE least(greatest(srch_co - srch_ci, 0), 14) END)::int AS stay_nights, (CASE WHEN srch_ci IS NULL THEN 30 ELSE least(greatest(srch_ci - date_time::date, 0), 60) END)::int AS days_until_checkin FROM ({_WIDE})) GROUP BY ALL ORDER BY event_count DESC, is_mobile, is_package, stay_nights, days_until_checkin LIMIT 200")
def booking_training_cells(spark, sf_dir):
    return backtest.training_cells(wide_source(spark, sf_dir), 200)


_BT = f"WITH x AS ({_WIDE}), p AS (SELECT user_id, count(*) AS n, count(*) FILTER (is_booking = 1) AS b, count(*) FILTER (srch_destination_id < 20) AS d FROM x WHERE date_time < TIMESTAMP '1998-01-01' GROUP BY user_id), o AS (SELECT DISTINCT user_id FROM x WHERE is_booking = 1 AND date_time >= TIMESTAMP '1998-01-01' AND date_time < TIMESTAMP '1999-01-01')"


def _backtest(spark, sf_dir):
    x = wide_source(spark, sf_dir)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    p = x.where(F.col("date_time") < at("1998-01-01")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_booking") == 1).alias("b"), F.count_if(F.col("srch_destination_id") < 20).alias("d"))
    later = x.where((F.col("is_booking") == 1) & (F.col("date_time") >= at("1998-01-01")) & (F.col("date_time") < at("1999-01-01"))).select("user_id").distinct().withColumn("booked", F.lit(True))
    return p.join(later, "user_id", "left").withColumn("booked", F.coalesce("booked", F.lit(False)))


@query("backtest_profiles", f"{_BT} SELECT p.*, user_id IN (SELECT user_id FROM o) AS booked FROM p")
def backtest_profiles(spark, sf_dir):
    return _backtest(spark, sf_dir)


_GROUPS = f"{_BT}, g AS (SELECT n % 5 AS g, count(*) AS size, count(*) FILTER (user_id IN (SELECT user_id FROM o)) AS won, avg(b / n) AS predicted FROM p GROUP BY n % 5)"


def _groups(spark, sf_dir):
    return _backtest(spark, sf_dir).groupBy((F.col("n") % 5).alias("g")).agg(F.count(F.lit(1)).alias("size"), F.count_if("booked").alias("won"), F.avg(F.col("b") / F.col("n")).alias("predicted"))


@query("brier_summary", f"{_GROUPS} SELECT round(sum(won * (1 - predicted) * (1 - predicted) + (size - won) * predicted * predicted) / sum(size), 6) AS brier, round(avg(abs(predicted - won / size)), 6) AS mae, round(avg(predicted - won / size), 6) AS bias FROM g")
def brier_summary(spark, sf_dir):
    found = backtest.brier(_groups(spark, sf_dir), F.col("predicted"), F.col("size"), F.col("won"))
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


_RQ = "WITH t AS (SELECT srch_destination_id AS scenario, c AS rank, count(*) FILTER (is_booking = 1) / count(*) AS actual FROM (SELECT *, (user_id % 3 + 1)::int AS c FROM ({wide})) GROUP BY ALL), b AS (SELECT srch_destination_id AS scenario, count(*) FILTER (is_booking = 1) / count(*) AS baseline FROM ({wide}) GROUP BY ALL), r AS (SELECT t.*, baseline FROM t JOIN b USING (scenario) WHERE baseline > 0)"


_TIED = "abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-12)"
_T = lambda a, b: _TIED.format(a=a, b=b)


@query(
    "rank_quality",
    _RQ.format(wide=_WIDE)
    + f""", s AS (SELECT scenario, any_value(baseline) AS b, any_value(actual) FILTER (rank = 1) AS x, any_value(actual) FILTER (rank = 2) AS y, any_value(actual) FILTER (rank = 3) AS z, count(*) AS n, count(*) FILTER (actual > baseline) AS w, min(actual - baseline) * 100 AS worst FROM r GROUP BY scenario),
  p AS (SELECT a.scenario, count(*) FILTER (NOT {_T("a.actual", "c.actual")} AND a.actual > c.actual) AS con, count(*) FILTER (NOT {_T("a.actual", "c.actual")} AND a.actual < c.actual) AS dis, count(*) FILTER ({_T("a.actual", "c.actual")}) AS tie FROM r a JOIN r c ON a.scenario = c.scenario AND a.rank < c.rank GROUP BY a.scenario),
  q AS (SELECT s.*, coalesce(con, 0) AS con, coalesce(dis, 0) AS dis, coalesce(tie, 0) AS tie, x IS NOT NULL AND (y IS NULL OR (x > y AND NOT {_T("x", "y")})) AND (z IS NULL OR (x > z AND NOT {_T("x", "z")})) AS strict, x IS NOT NULL AND {_T("x", "greatest(x, y, z)")} AS level FROM s LEFT JOIN p USING (scenario))
  SELECT count(*) AS scenarios, sum(n)::bigint AS candidates, sum(w)::bigint AS beating, round((SELECT avg((actual - baseline) * 100) FROM r), 6) AS mean_lift_pp, round(sum(w) / sum(n), 6) AS beating_rate, round(count(*) FILTER (w > 0) / count(*), 6) AS any_beat_rate, round(count(*) FILTER (w = n) / count(*), 6) AS all_beat_rate, round(avg(worst), 6) AS mean_worst_lift_pp,
    count(*) FILTER (n > 1) AS multi, count(*) FILTER (n = 3) AS three, count(*) FILTER (con + dis > 0) AS comparable, round(count(*) FILTER (con + dis > 0) / count(*), 6) AS comparable_rate, round(count(*) FILTER (con + dis > 0 AND strict) / nullif(count(*) FILTER (con + dis > 0), 0), 6) AS rank_one_best_rate,
    round(count(*) FILTER (n > 1 AND level AND NOT (con + dis > 0 AND strict)) / nullif(count(*) FILTER (n > 1), 0), 6) AS rank_one_tied_rate, sum(con)::bigint AS concordant, sum(dis)::bigint AS discordant, sum(tie)::bigint AS tied, round(sum(con) / nullif(sum(con + dis), 0), 6) AS pair_accuracy, round(sum(tie) / nullif(sum(con + dis + tie), 0), 6) AS tie_rate, round(coalesce(avg((x - y) * 100), 0), 6) AS mean_one_minus_two_pp,
    """
    + ", ".join(f"count({c}) AS rank_{i}, round(count({c}) / count(*), 6) AS rank_{i}_coverage, round(count(*) FILTER ({c} > b) / count({c}), 6) AS rank_{i}_beating_rate, round(avg(({c} - b) * 100), 6) AS rank_{i}_mean_lift_pp" for i, c in enumerate("xyz", 1))
    + " FROM q",
)
def rank_quality(spark, sf_dir):
    w = wide_source(spark, sf_dir).withColumn("rank", (F.col("user_id") % 3 + 1).cast("int")).withColumnRenamed("srch_destination_id", "scenario")
    rate = F.count_if(F.col("is_booking") == 1) / F.count(F.lit(1))
    outcomes = w.groupBy("scenario", "rank").agg(rate.alias("actual")).join(w.groupBy("scenario").agg(rate.alias("baseline")), "scenario")
    found = backtest.rank_quality(outcomes, "scenario")
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))
