"""Operators on small hand-made inputs with known answers."""

from __future__ import annotations

import hashlib
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing, safe, text, vectors
from tidemark.operators import allocation, evaluation, experiments, features, ledger, models, predicates, profiles, ranking, uplift, vector_search
from tidemark.operators.predicates import Condition, PropertyFilter, Request
from tidemark.sources import event_log


def col(df, name=None):
    return [r[0] for r in df.collect()]


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_stable_bucket_is_that_of_hashlib(spark):
    names = ["", "jeju", "서울", "user-1"]
    got = [one(spark, hashing.stable_bucket(F.lit(n), 97)) for n in names]
    assert got == [int.from_bytes(hashlib.sha256(n.encode()).digest()[:8], "big") % 97 for n in names]


def test_signed_coordinate_is_that_of_hashlib(spark):
    for n in ("jeju", "japan", "paris"):
        digest = hashlib.sha256(n.encode()).digest()
        bucket, sign = hashing.signed_coordinate(F.lit(n))
        assert one(spark, bucket) == int.from_bytes(digest[:8], "big") % 16
        assert one(spark, sign) == (1.0 if digest[8] % 2 == 0 else -1.0)


def test_canonical_destination(spark):
    cases = {" Jeju  Island ": "jeju", "제주도": "jeju", "도쿄": "japan", "NEW  york": "new york", "": ""}
    assert {k: one(spark, text.canonical_destination(F.lit(k))) for k in cases} == cases


def test_safe_casts(spark):
    flags = {"1": 1, "0": 0, "255": 255, "256": 0, "true": 0, "": 0, "-1": 0, "1.5": 0}
    assert {k: one(spark, safe.uint8_or_zero(F.lit(k))) for k in flags} == flags
    dates = {"2024-06-01": "2024-06-01", "2024/06/01": "2024-06-01", "20240601": "2024-06-01", "2024-06-01 10:00:00": "2024-06-01", "soon": None, "": None}
    assert {k: one(spark, safe.date_or_null(F.lit(k)).cast("string")) for k in dates} == dates
    assert one(spark, safe.ratio6(F.lit(1), F.lit(3))) == 0.333333
    assert one(spark, safe.ratio6(F.lit(1), F.lit(0))) == 0.0


def test_cosine_of_zero_and_null(spark):
    v = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.cosine(v, v)) == 1.0
    assert one(spark, vectors.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) == -1.0
    assert one(spark, vectors.cosine(v, F.lit(None).cast("array<double>"))) == -1.0
    assert not one(spark, vectors.is_valid(F.array(F.lit(float("nan")), F.lit(1.0)), 2))
    assert not one(spark, vectors.is_valid(F.lit(None).cast("array<double>"), 2))


EVENT_COLUMNS = ["project_id", "event_id", "event_name", "event_time", "received_at", "source", "user_id", "properties_json", "validation_status"]


def events(spark, rows):
    """rows: (event_name, user_id, day, payload dict, valid)."""
    import json

    data = [("p1", i, n, datetime(2024, 1, d), datetime(2024, 1, d), "web", u, json.dumps(p), "valid" if ok else "invalid") for i, (n, u, d, p, ok) in enumerate(rows)]
    raw = spark.createDataFrame(data, "project_id string, event_id long, event_name string, event_time timestamp_ntz, received_at timestamp_ntz, source string, user_id string, properties_json string, validation_status string")
    return event_log.typed(event_log.window(raw, datetime(2024, 1, 1), datetime(2024, 1, 31)))


def test_hard_predicates_on_six_users(spark):
    rows = [
        ("hotel_search", "a", 2, {"destination_name": "Jeju"}, True),
        ("hotel_search", "a", 3, {"destination_name": "제주"}, True),
        ("booking_start", "b", 4, {"deal": "package_bundle"}, True),
        ("promotion_click", "c", 5, {"deal": "1"}, True),
        ("hotel_click", "d", 6, {"destination_name": "Seoul"}, True),
        ("hotel_click", "d", 7, {"destination_name": "Busan"}, True),
        ("hotel_search", "e", 8, {"destination_name": "Jeju"}, False),
        ("booking_start", "f", 9, {"checkin_date": "2024-07-01"}, True),
        ("booking_complete", "f", 10, {"free_cancellation": "1"}, True),
    ]
    ev = events(spark, rows)
    find = lambda *keys, **k: sorted(col(predicates.matching_users(ev, Request("r", keys, **k))))
    assert find("target_destination_affinity", destinations=["jeju"]) == ["a"]
    assert find("recent_destination_search", destinations=["jeju", "seoul"]) == ["a", "d"]
    assert find("booking_start_without_complete") == ["b"]
    assert find("benefit_interest") == ["c", "f"]  # a deal written as a word is no flag
    assert find("benefit_interest", benefits=["free_cancellation"]) == ["f"]
    assert find("promotion_response") == ["c"]
    assert find("general_destination_exploration") == ["d"]
    assert find("season_match", months=[7]) == ["f"]
    two = (Condition("hotel_search", 2, 2, "jeju"),)
    assert find("structured_conditions", conditions=two) == ["a"]
    with pytest.raises(ValueError):
        find("no_such_predicate")
    requests = [Request("x", ["promotion_response"]), Request("y", ["hotel_product_interest"])]
    assert {r["name"]: r["users"] for r in predicates.batch_match_counts(ev, requests).collect()} == {"x": 1, "y": 2}
    assert col(predicates.matching_users(ev.where("false"), requests[0])) == []


def test_property_filters(spark):
    ev = events(spark, [("hotel_search", "a", 2, {"deal": "Package_Bundle", "price": "120"}, True), ("hotel_search", "b", 2, {"price": "dear"}, True)])
    hits = lambda *f: sorted(col(ev.where(PropertyFilter(*f).column()).select("user_id")))
    assert hits("deal", "exists") == ["a"] and hits("deal", "contains", "BUNDLE") == ["a"] and hits("deal", "in", "x, package_bundle") == ["a"]
    assert hits("price", "gte", "100") == ["a"] and hits("price", "lte", "100") == [] and hits("deal", "equals", "package_bundle") == ["a"]
    with pytest.raises(ValueError):
        PropertyFilter("deal", "like", "x").column()


def test_canonical_conditions():
    one_of = lambda **k: {"event_name": "hotel_search", "property_key": "price", "operator": "gte", "value": "10", **k}
    same, refused = predicates.canonical_conditions([one_of(value="10.0"), one_of(), one_of(value=" 1E+1 ")])
    assert [(c.key, c.operator, c.value, c.minimum) for c in same] == [("price", "gte", "10", 1)] and refused == []
    spelt = [one_of(property_key="free_cancellation", operator="equals", value="예"), one_of(property_key="age_group", operator="in", value="30s/20대"), one_of(property_key="gender", operator="in", value="여성, f"), one_of(property_key="deal", operator="exists", value=None)]
    assert {c.key: c.value for c in predicates.canonical_conditions(spelt)[0]} == {"free_cancellation": "true", "age_group": "20,20-29,20대,20s,30,30-39,30대,30s", "gender": "f,female,여,여성", "deal": "true"}
    wrong = [one_of(event_name=""), one_of(property_key="x"), one_of(operator="like"), one_of(minimum_count=0), one_of(value="many"), 7]
    assert predicates.canonical_conditions(wrong) == ([], [f"property_condition:{w}" for w in ("unsupported_event:missing", "unsupported_property:x", "unsupported_operator:like", "invalid_minimum_count", "invalid_numeric_value:price", "invalid_item")])
    assert predicates.canonical_conditions(None) == ([], []) and predicates.canonical_conditions("x") == ([], ["property_condition:invalid_array"])
    assert len(predicates.canonical_conditions([one_of(value=str(i)) for i in range(9)])[0]) == predicates.MOST_CONDITIONS


def test_canonical_condition_counts_events(spark):
    ev = events(spark, [("hotel_search", "a", 21, {"gender": "여"}, True), ("hotel_search", "a", 22, {"gender": "F"}, True), ("hotel_search", "b", 22, {"gender": "m"}, True)])
    (found,), _ = predicates.canonical_conditions([{"event_name": "hotel_search", "property_key": "gender", "operator": "in", "value": "female", "minimum_count": 2}])
    got = predicates.condition_match_counts(ev, [found.condition()]).collect()
    assert {r["user_id"]: r["matches"] for r in got} == {"a": 1, "b": 0}


def test_vector_v2_of_one_user(spark):
    ev = events(spark, [("hotel_search", "a", 21, {"destination_name": "Jeju", "price": "100000", "checkin_date": "2024-01-27"}, True), ("booking_start", "a", 31 - 1, {}, True)])
    v = features.behavior_vector_v2(ev, datetime(2024, 1, 31)).first()["behavior_vector"]
    assert len(v) == 64 and math.isclose(sum(x * x for x in v), 1.0, rel_tol=1e-9)
    ratio = lambda i, j: v[i] / v[j]
    assert math.isclose(ratio(7, 56), math.exp(-10 / 30))  # search recency against an indicator
    assert math.isclose(ratio(1, 56), math.log(2) / math.log(3)) and ratio(14, 56) == 1.0
    assert ratio(35, 56) == 1.0 and ratio(39, 56) == 1.0 and ratio(36, 56) == 1.0  # winter, weekend, lead time of 6 days
    assert sum(x != 0 for x in v[16:32]) == 1 and ratio(43, 56) == 1.0 and v[41] == 0.0
    assert features.behavior_vector_v2(ev.where("false"), datetime(2024, 1, 31)).count() == 0


def test_query_vector_is_of_length_one():
    v = features.query_vector({1: 1.0, 3: 1.0, 40: 2.0}, {"funnel": (0, 15), "benefit": (40, 47)}, {"funnel": 0.6, "benefit": 0.4})
    assert math.isclose(sum(x * x for x in v), 1.0) and math.isclose(v[1], v[3]) and math.isclose(v[40] / v[1], 0.4 / (0.6 / math.sqrt(2)))


def test_ledger(spark):
    s = "k long, v string, n long"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, None, 1)], s)
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (4, "e", 1), (4, "f", 2), (3, "g", 1)], s)
    rows = lambda d: sorted(map(tuple, d.select("k", "v", "n").collect()))
    assert rows(ledger.upsert_latest_wins(old, new, ["k"], ["n"])) == [(1, "c", 2), (2, "b", 5), (3, "g", 1), (4, "f", 2)]
    assert rows(ledger.insert_if_absent(old, new, ["k"], "n")) == [(4, "e", 1)]
    assert rows(ledger.upsert_coalesce(old, ledger.latest(new, ["k"], ["n"]), ["k"], ["v"])) == [(1, "a", 2), (2, "b", 4), (3, "g", 1), (4, "f", 2)]
    book = spark.createDataFrame([(1, "reserved", 1), (1, "consumed", 2), (2, "reserved", 1)], "k long, state string, revision long")
    asked = spark.createDataFrame([(1, "released"), (2, "consumed"), (9, "consumed")], "k long, state string")
    assert [tuple(r) for r in ledger.transition(book, ["k"], asked, {"consumed": ["reserved"], "released": ["reserved"]}).collect()] == [(2, "consumed", 2)]


def test_global_rank_has_no_gaps(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("s"))
    got = ranking.global_rank(rows, [F.desc("s"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["s"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))


def test_strength_cut_falls_back_to_all(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", i, 1.0) for i in range(3)], "g string, id long, s double")
    kept = ranking.strength_cut(rows, ["g"], F.col("s"), "id", 0.35, 2).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in kept} == {"a": 4, "b": 2}
    assert ranking.strength_cut(rows, ["g"], F.col("s"), "id", 0.35, 4).where("g = 'b'").count() == 3


def test_holdout_quota_and_hmac(spark):
    rows = spark.createDataFrame([("e1", f"u{i}") for i in range(5)] + [("e2", "u9")], "e string, u string")
    got = experiments.holdout(rows, "e", "u", 0.5, "salt", ("p1", "run1")).collect()
    key = {f"u{i}": experiments.hmac_plain("salt", "p1", "run1", "e1", f"u{i}") for i in range(5)}
    treated = set(sorted(key, key=lambda u: (key[u], u))[:3])
    assert {r["u"] for r in got if r["arm"] == "treatment"} == treated
    assert {r["treatment_probability"] for r in got if r["e"] == "e1"} == {0.6}
    assert [r["arm"] for r in got if r["e"] == "e2"] == [None]


def test_holdout_quota_of_an_exact_half_is_rounded_up(spark):
    sizes = (5, 45, 85, 165, 645)
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "e long, u long")
    treated = experiments.holdout(rows, "e", "u", 0.7).groupBy("e").agg(F.count_if(F.col("arm") == "treatment").alias("t"), F.min("treatment_probability").alias("p"))
    assert {r["e"]: (r["t"], r["p"]) for r in treated.collect()} == {n: ((7 * n + 5) // 10, (7 * n + 5) // 10 / n) for n in sizes}
    nulls = experiments.holdout(spark.createDataFrame([(1, None), (1, 4), (1, 2)], "e long, u long"), "e", "u", 0.5).collect()
    assert {r["u"]: r["arm"] for r in nulls} == {2: "treatment", 4: "treatment", None: "control"}


def test_match_segments_reasons(spark):
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    users = spark.createDataFrame([(1, axis(0)), (2, [0.0] * 4), (3, axis(3)), (4, None)], "vec_id long, embedding array<double>")
    segs = spark.createDataFrame([("s2", axis(1)), ("s1", axis(0))], "segment_id string, centroid array<double>")
    got = {r["vec_id"]: (r["segment_id"], r["fallback_reason"]) for r in vector_search.match_segments(users, segs, 4).collect()}
    assert got == {1: ("s1", None), 2: ("fallback", "invalid_vector"), 3: ("fallback", "below_threshold"), 4: ("fallback", "invalid_vector")}
    none = vector_search.match_segments(users.where("vec_id = 1"), segs.where("false"), 4).first()
    assert none["fallback_reason"] == "no_candidate"
    assert vector_search.search_method(50_000) == "exact" and vector_search.search_method(500_001) == "index"
    upper = lambda m, n: one(spark, vector_search.wilson_upper(F.lit(m), F.lit(n)))
    assert math.isclose(upper(0, 100), 0.03699348, rel_tol=1e-5) and upper(0, 0) == 1.0 and upper(5, 5) == 1.0


def test_qini_of_an_even_split(spark):
    rows = spark.createDataFrame([(i, 8.0 - i, i % 2, 0.5, 1 if i in (1, 3, 4) else 0) for i in range(8)], "unit long, score double, treatment int, probability double, outcome int")
    curve = {r["unit"]: r["gain"] for r in uplift.qini_curve(rows, "score", "unit").collect()}
    assert [curve[i] for i in range(8)] == [0, 1, 1, 2, 1, 1, 1, 1]
    rates = uplift.ipw_rates(rows).first()
    assert (rates["treatment_rate"], rates["control_rate"], rates["ate"]) == (0.5, 0.25, 0.25)
    s = uplift.qini_summary(uplift.qini_curve(rows, "score", "unit")).first()
    assert math.isclose(s["qini"], 1.0 - 1.0 * 4.5 / 8)


def test_mixed_propensities_give_the_true_effect(spark):
    rows = []
    for p, control in ((0.2, 0.1), (0.5, 0.3), (0.8, 0.5)):
        n1, n0 = int(1000 * p), int(1000 * (1 - p))
        rows += [(1, p, 1 if i < round(n1 * (control + 0.1)) else 0) for i in range(n1)] + [(0, p, 1 if i < round(n0 * control) else 0) for i in range(n0)]
    df = spark.createDataFrame(rows, "treatment int, probability double, outcome int")
    assert abs(uplift.ipw_rates(df).first()["ate"] - 0.1) < 1e-3


def test_ridge_recovers_a_line(spark):
    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 1)
    model = uplift.fit_ridge(rows, ["a", "b"], "y", 1e-6)
    worst = rows.select(F.max(F.abs(model.column([F.col("a"), F.col("b")]) - F.col("y")))).first()[0]
    assert worst < 1e-5
    assert uplift.cluster_bootstrap([(1.0, 2)]) == (None, None) == uplift.cluster_bootstrap([])
    assert uplift.percentile([1.0, 2.0, 4.0], 0.75) == 3.0 and uplift.cluster_bootstrap([(1.0, 1), (1.0, 1)], 3) == (1.0, 1.0)
    assert uplift.cluster_bootstrap([(1.0, 2), (2.0, 2), (0.0, 2)], 200) == uplift.cluster_bootstrap([(1.0, 2), (2.0, 2), (0.0, 2)], 200)


def test_logistic_and_heuristic(spark):
    model = models.fit_logistic([[0.0], [1.0]], [10, 80], [100, 100], l2=0.0, steps=5000)
    assert abs(one(spark, model.column([F.lit(1.0)])) - 0.8) < 1e-3
    held = one(spark, model.guarded([F.lit(50.0)], F.lit(30.0), 0.1))
    assert held < 1.0 and abs(held - (0.5 * one(spark, model.column([F.lit(50.0)], 3.0)) + 0.05)) < 1e-9
    zero = {k: F.lit(0.0) for k in [*models.DESTINATION_SIGNAL, *models.INTENT_SIGNAL, "eligible_destination_match_user_rate", "promotion_condition_match"]}
    assert abs(one(spark, models.heuristic_rate(zero, True)) - 0.001) < 1e-12
    at, margin = models.calibrate_threshold([0.8, 0.9], [0.4, 0.1], 0.3)
    assert math.isclose(at, 0.6) and math.isclose(margin, 0.4)
    for accepted, rejected in (([0.5], [0.4]), ([], [0.1]), ([0.9], [])):
        with pytest.raises(ValueError):
            models.calibrate_threshold(accepted, rejected, 0.3)


def test_funnel_counts_later_stages_and_epochs(spark):
    at = lambda d: datetime(2024, 1, d)
    schema = "ad_experiment_id string, event_id long, user_id string, event_name string, event_time timestamp_ntz, source string, redirect_id string, revenue double, price string"
    touch = [("e", 1, "a", "promotion_click", at(5), "web", None, None, ""), ("e", 2, "b", "promotion_click", at(5), "fixture", "r1", None, "")]
    book = [("e", 3, "a", "booking_complete", at(6), "web", None, 5.0, "5"), ("e", 4, "b", "booking_start", at(4), "web", None, 9.0, "9")]
    seen = [("e", 5, "b", "hotel_detail_view", at(3), "web", None, None, ""), ("e", 6, "b", "hotel_detail_view", at(4), "web", None, None, "")]
    d = lambda rows: spark.createDataFrame(rows, schema)
    f = evaluation.funnel(d(touch), d(seen), d(book), "promotion_click", at(20)).first()
    assert (f["response_count"], f["hotel_search_count"], f["booking_start_count"], f["booking_complete_count"], f["fixture_response_count"]) == (2, 1, 1, 1, 1)
    c = evaluation.booking_intent_cohorts(d(touch), d(seen), d(book), "promotion_click", at(20)).first()
    assert (c["repeat_view_user_count"], c["comparison_booking_count"], c["booking_abandon_user_count"]) == (1, 1, 0)
    landed = [*touch, ("e", 7, "b", "campaign_landing", at(6), "web", "r1", None, ""), ("e", 8, "b", "campaign_redirect_click", at(6), "web", "r1", None, "")]
    i = evaluation.inflow(d(landed), at(20)).first()
    assert (i["numerator"], i["denominator"]) == (1, 1)


def test_statuses(spark):
    cases = [(0.9, 10, 10, "goal_met"), (0.4, 10, 10, "goal_not_met"), (0.9, 10, 3, "insufficient_data"), (0.9, 0, 10, "insufficient_data")]
    rows = spark.createDataFrame(cases, "actual double, d long, s long, wanted string")
    got = rows.withColumn("status", evaluation.goal_status(F.col("actual"), F.lit(0.5), F.col("d"), F.col("s"), 5))
    assert got.where("status <> wanted").count() == 0
    mixed = {"m": ["goal_met", "goal_not_met"], "n": ["goal_not_met", "insufficient_data"], "i": ["insufficient_data"], "g": ["goal_met"], "p": ["goal_met", "insufficient_data"]}
    runs = spark.createDataFrame([(r, s) for r, ss in mixed.items() for s in ss], "run string, status string")
    assert {r["run"]: r["run_status"] for r in evaluation.run_status(runs, "run").collect()} == {"m": "partial_goal_met", "n": "goal_not_met", "i": "insufficient_data", "g": "goal_met", "p": "partial_goal_met"}


def test_portfolio_takes_no_overlapping_candidate():
    assert profiles.pick_portfolio([("x", 1, 0.9), ("y", 1, 0.8), ("z", 2, 0.99)], {("x", "y"): 0.9}) == ["x", "z"]


def test_written_lists(spark):
    assert text.list_values(" Seoul，busan/제주 또는 SEOUL·차이나타운") == ["busan", "seoul", "제주", "차이나타운"]
    assert text.search_terms("제주, 서울") == ["jeju", "seoul", "서울", "제주"] and text.search_terms("Paris") == ["paris"] and text.search_terms("A또는B") == ["a또는b"]
    assert one(spark, text.split_values(F.lit("b，A혹은 a/"))) == ["a", "b"]


def test_group_rank_cuts_groups(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else f"g{i % 3}", i, i % 5) for i in range(300)], "g string, id long, v long")
    got = ranking.group_rank(rows, ["g"], [F.desc("v"), F.col("id")]).collect()
    expected = {}
    for g in {r["g"] for r in got}:
        own = sorted(((r["v"], r["id"]) for r in got if r["g"] == g), key=lambda x: (-x[0], x[1]))
        expected |= {(g, i): (k + 1, len(own)) for k, (_, i) in enumerate(own)}
    assert {(r["g"], r["id"]): (r["_rank"], r["_n"]) for r in got} == expected
    medians = {r["g"]: r["median"] for r in ranking.lower_median(rows, ["g"], "id").collect()}
    assert medians == {None: 147, "g1": 148, "g2": 149}


def test_many_segments_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    segs = spark.createDataFrame([(f"s{i:03d}", vector()) for i in range(60)] + [("zero", [0.0] * 6), ("s900", [1.0] + [0.0] * 5), ("s901", [2.0] + [0.0] * 5)], "segment_id string, centroid array<double>")
    users = spark.createDataFrame([(i, vector()) for i in range(40)] + [(100, None), (101, [0.0] * 6), (102, [1.0] + [0.0] * 5)], "vec_id long, embedding array<double>")
    shown = lambda df: [(r["vec_id"], [(s["id"], round(s["score"], 9)) for s in r["nearest"]]) for r in df.orderBy("vec_id").collect()]
    few = shown(vector_search.nearest_segments(users, segs, 3))
    monkeypatch.setattr(vector_search, "MOST_SEGMENTS", 5)
    monkeypatch.setattr(vector_search, "BLOCK_SEGMENTS", 7)
    assert shown(vector_search.nearest_segments(users, segs, 3)) == few


def test_allocation(spark):
    members = spark.createDataFrame([("x", 1, 0.9), ("x", 2, 0.6), ("y", 1, 0.7), ("y", 2, 0.9), ("y", 3, 0.5), ("z", 4, 0.9)], "snapshot_id string, user_id long, behavior_fit_score double")
    sources = spark.createDataFrame([("A", "x", 1, 0.5, 0.2, 2), ("B", "y", 1, 0.5, 0.1, 1), ("C", "z", 0, 0.5, 0.0, 1)], "segment_id string, snapshot_id string, priority int, score_threshold double, semantic_margin double, min_sample_size long")
    excluded = spark.createDataFrame([(4,)], "user_id long")
    won = lambda **k: {r["user_id"]: r["segment_id"] for r in allocation.winners(members, sources, **k).collect()}
    assert won() == {1: "A", 2: "B", 3: "B", 4: "C"} and won(excluded=excluded) == {1: "A", 2: "B", 3: "B"}
    seen = {(tuple(r["segments"]), r["segment_id"]): (r["users"], r["audience_status"]) for r in allocation.preview(members, sources, excluded).collect()}
    assert len(seen) == 12 and seen[("A",), "A"] == (2, "targetable") and seen[("A", "B"), "A"] == (1, "insufficient_sample") and seen[("A", "B", "C"), "C"] == (0, "no_eligible_audience")
    with pytest.raises(ValueError):
        allocation.preview(members, sources, most=2)
    key = "analysis_id string, segment_id string, plan_id string, snapshot_id string"
    targets = spark.createDataFrame([("n", "A", "p", "x", "confirmed"), ("n", "B", "p", "y", "confirmed"), ("n", "C", "p", "z", "stopped")], key + ", status string")
    bindings = spark.createDataFrame([("n", "B", "p", "y", "r1")], key + ", run_id string")
    runs = spark.createDataFrame([("r1", "completed")], "run_id string, status string")
    active = allocation.active_targets(targets, bindings, runs)
    assert [r["segment_id"] for r in active.collect()] == ["A"]
    held = spark.createDataFrame([(7, "reserved", "n", "A", "p", "x"), (8, "released", "n", "A", "p", "x"), (9, "consumed", "n", "B", "p", "y")], "user_id long, state string, " + key)
    assert col(allocation.excluded_users(held, active)) == [7]


def test_rank_quality_of_three_scenarios(spark):
    from tidemark.operators import backtest, policies

    rows = [("a", 1, 0.5, 0.2), ("a", 2, 0.3, 0.2), ("a", 3, 0.1, 0.2), ("b", 1, 0.4, 0.3), ("b", 2, 0.4, 0.3), ("c", 2, 0.1, 0.1), ("d", 1, 0.9, 0.0), ("a", 4, 9.0, 0.2)]
    r = backtest.rank_quality(spark.createDataFrame(rows, "scenario string, rank int, actual double, baseline double"), "scenario").first()
    assert (r["scenarios"], r["candidates"], r["beating"], r["multi"], r["three"], r["comparable"]) == (3, 6, 4, 2, 1, 1)
    assert (r["concordant"], r["discordant"], r["tied"], r["rank_one_best_rate"], r["rank_one_tied_rate"]) == (3, 0, 1, 1.0, 0.5)
    assert math.isclose(r["any_beat_rate"], 2 / 3) and math.isclose(r["all_beat_rate"], 1 / 3) and math.isclose(r["mean_worst_lift_pp"], 0.0, abs_tol=1e-9)
    assert (r["rank_1"], r["rank_2"], r["rank_3"]) == (2, 3, 1) and math.isclose(r["rank_1_coverage"], 2 / 3) and math.isclose(r["mean_one_minus_two_pp"], 10.0)
    none = backtest.rank_quality(spark.createDataFrame(rows[-2:], "scenario string, rank int, actual double, baseline double"), "scenario").first()
    assert none["scenarios"] == 0 and none["beating_rate"] is None
    c = policies.Criterion
    rules = [c("scenarios", ">=", 3, True), c("beating_rate", ">=", 0.6), c("tie_rate", "<=", 0.3)]
    assert policies.verdict(rules, r.asDict()) == "passed" and policies.verdict(rules, none.asDict()) == "inconclusive" and policies.verdict(rules[1:], r.asDict()) == "inconclusive"
    assert policies.verdict([*rules, c("mean_lift_pp", ">", 99)], r.asDict()) == "failed"
