"""Sources and sinks, query vectors, prediction models and gates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audience_search as vector_index
from ..operators import backtest, experiments, ledger, models, policies, predicates, profiles, query_vectors, uplift
from ..sources import files, scratch
from .analytics import _GROUPS, _PROFILE, _UNITS, _WIDE, _groups, _units, user_profiles, wide_source
from .audience import with_raw

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sources and sinks


@query("projected_scan", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def projected_scan(spark, sf_dir):
    return files.projected(spark, f"{sf_dir}/events.parquet", ["event_id", "event_type"], "ts", "2024-01-05", "2024-01-12")


@query("csv_load_once", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_load_once(spark, sf_dir):
    """Customers through CSV files with a checked header into a table that a second load leaves alone."""
    folder = scratch.new_folder(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows.write.option("header", True).csv(f"{folder}/csv")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    loaded = files.read_csv(spark, f"{folder}/csv", schema)
    files.load_once(spark, loaded, f"{folder}/table")
    files.load_once(spark, loaded.where("false"), f"{folder}/table")
    return spark.read.parquet(f"{folder}/table")


@query("active_generation", "SELECT vec_id, label FROM embeddings WHERE label <> 1")
def active_generation(spark, sf_dir):
    """Vectors of the generation that was activated last; it was written in two goes."""
    root = scratch.new_folder(spark, "generations")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    held = files.Generations(spark, root)
    held.activate("first", held.write("first", vectors))
    later = vectors.where("label <> 1")
    held.write("second", later.where("label > 3"))
    held.activate("second", held.resume("second", later, ["vec_id"]))
    return held.read().select("vec_id", "label")


@query("temporary_relation", "SELECT n AS eligible, count(*) AS orders, count(DISTINCT o_custkey) AS buyers FROM orders JOIN (SELECT c_custkey, count(*) OVER () AS n FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey GROUP BY n")
def temporary_relation(spark, sf_dir):
    """A relation made for one job, counted and joined, and then dropped."""
    eligible = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    with scratch.relation(spark, "tidemark_eligible", eligible) as n:
        orders = table(spark, sf_dir, "orders").join(spark.table("tidemark_eligible"), F.col("o_custkey") == F.col("c_custkey"))
        found = orders.agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("buyers")).first()
    return spark.createDataFrame([(n, *found)], "eligible long, orders long, buyers long")


@query("append_arrays", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey, o_orderstatus FROM orders")
def append_arrays(spark, sf_dir):
    """Orders of a customer, given as parallel arrays, as rows."""
    kept = F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    batches = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(kept.alias("s")).select("o_custkey", F.col("s.o_orderkey").alias("o_orderkey"), F.col("s.o_orderstatus").alias("o_orderstatus"))
    return ledger.append_arrays(batches, ["o_orderkey", "o_orderstatus"])


# Query vectors


def _signal_rows(kind: str) -> list[str]:
    """The signals of a type for jeju, winter and free cancellation, as SQL values (kind, block, weight, place, signal)."""
    names = list(query_vectors.CANDIDATE_SIGNALS[kind])
    if kind == "benefit_value_seeker":
        names = [n for n in names if not any(n in b for b in query_vectors.BENEFITS.values())] + ["free_cancellation_interest"]
    rows = []
    for block, weight in query_vectors.BLOCK_WEIGHTS[kind].items():
        lo, hi = query_vectors.BLOCKS[block]
        rows += [f"('{kind}', '{block}', {weight}, {i}, 1.0)" for i in sorted(query_vectors.SIGNALS[n] for n in [*names, "winter_checkin_share"]) if lo <= i <= hi]
        if block == "destination":
            rows.append(f"('{kind}', 'destination', {weight}, 16 + (('0x' || substr(sha256('jeju'), 1, 16))::UBIGINT % 16)::int, CASE WHEN ('0x' || substr(sha256('jeju'), 17, 2))::int % 2 = 1 THEN -1.0 ELSE 1.0 END)")
    return rows


@query(
    "candidate_query_vectors",
    "SELECT candidate, place::int AS place, round(v / sqrt(sum(v * v) OVER (PARTITION BY candidate)), 6) AS value FROM (SELECT candidate, place, weight * x / sqrt(sum(x * x) OVER (PARTITION BY candidate, block)) AS v FROM (VALUES " + ", ".join(r for k in query_vectors.BLOCK_WEIGHTS for r in _signal_rows(k)) + ") t(candidate, block, weight, place, x))",
)
def candidate_query_vectors(spark, sf_dir):
    """The places of each candidate type's query vector that aren't 0."""
    found = [(k, i, round(x, 6)) for k in query_vectors.BLOCK_WEIGHTS for i, x in enumerate(query_vectors.candidate_query(k, ["제주도"], ["winter"], ["free_cancellation"])) if x]
    return spark.createDataFrame(found, "candidate string, place int, value double")


_LIKE = "list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0))"


@query("audience_search", f"SELECT vec_id, round({_LIKE}, 6) AS score FROM embeddings WHERE label <> 1 AND {_LIKE} >= 0.1")
def audience_search(spark, sf_dir):
    """Members of an audience by the search policy; beyond 500,000 vectors the index finds them, audited for a recall of 0.95."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    index = vector_index.CellIndex.build(vectors, f"{scratch.new_folder(spark, 'index')}/cells", "vec_id")
    query_vector = vectors.where("vec_id = 0").first()["embedding"]
    found = vector_index.search(index, query_vector, 0.1, vectors.where("label <> 1"))
    return found.members.select("vec_id", F.round("score", 6).alias("score"))


@query("profile_array_match", with_raw(f"SELECT user_id, len(list_filter(hotel_market_values, lambda x: contains(x, '12') OR contains(x, '7'))) > 0 AS matched FROM ({_PROFILE})"))
def profile_array_match(spark, sf_dir):
    return user_profiles(spark, sf_dir).select("user_id", predicates.profile_array_match(F.col("hotel_market_values"), ["12", "7"]).alias("matched"))


# Models

_G = f"SELECT hotel_search_count % 4 AS g, avg((destination_match_count > 0)::int) AS du, sum(destination_match_count) / sum(event_count) AS de, avg((destination_match_count > 0 AND season_match_count > 0)::int) AS el, avg((hotel_detail_view_count > 0)::int) AS dv, avg((booking_start_count > booking_complete_count)::int) AS fr, avg((booking_start_count > 0)::int) AS bs, avg((deal_event_count + free_cancellation_count + breakfast_included_count + price_event_count > 0)::int) AS be, avg((promotion_click_count + campaign_landing_count > 0)::int) AS pr, count(*) AS n FROM ({_PROFILE}) GROUP BY g"


def _rates(spark, sf_dir):
    """Signal rates of four groups of profiles."""
    n, share = profiles.n, lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return (
        user_profiles(spark, sf_dir)
        .groupBy((n("hotel_search") % 4).alias("g"))
        .agg(
            share(n("destination_match") > 0).alias("destination_match_user_rate"),
            (F.sum(n("destination_match")) / F.sum("event_count")).alias("destination_match_event_rate"),
            share((n("destination_match") > 0) & (n("season_match") > 0)).alias("eligible_destination_match_user_rate"),
            share(n("hotel_detail_view") > 0).alias("hotel_detail_view_user_rate"),
            share(n("booking_start") > n("booking_complete")).alias("funnel_recovery_user_rate"),
            share(n("booking_start") > 0).alias("booking_start_user_rate"),
            share(n("deal_event") + n("free_cancellation") + n("breakfast_included") + n("price_event") > 0).alias("benefit_user_rate"),
            share(n("promotion_click") + n("campaign_landing") > 0).alias("promotion_response_user_rate"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("promotion_condition_match", F.lit(0.5))
    )


@query("heuristic_rate", with_raw(f"SELECT g, round(least(greatest(CASE WHEN 0.7 * du + 0.3 * de <= 0 THEN 0.2 ELSE 1.0 END * (0.005 + 0.08 * (0.7 * du + 0.3 * de) + 0.04 * el + 0.025 * (0.3 * dv + 0.25 * fr + 0.2 * bs + 0.15 * be + 0.1 * pr) + 0.02 * 0.5), 0), 1), 6) AS rate FROM ({_G})"))
def heuristic_rate(spark, sf_dir):
    rows = _rates(spark, sf_dir)
    return rows.select("g", F.round(models.heuristic_rate({c: F.col(c) for c in rows.columns}, True), 6).alias("rate"))


_Z = lambda x, m, s, c: f"{c} * least(greatest(({x} - {m}) / {s}, -3.0), 3.0)"


@query("performance_rate", with_raw(f"SELECT g, round(n / (n + 30.0) / (1 + exp(-(-2.0 + {_Z('dv', 0.4, 0.05, 0.3)} + {_Z('bs', 0.2, 0.4, -0.7)}))) + (1 - n / (n + 30.0)) * 0.08, 6) AS rate FROM ({_G})"))
def performance_rate(spark, sf_dir):
    """A logistic model's rate, its features held within three deviations, shrunk to the baseline in small samples."""
    model = models.Logistic([0.4, 0.2], [0.05, 0.4], [0.3, -0.7], -2.0)
    rate = model.guarded([F.col("hotel_detail_view_user_rate"), F.col("booking_start_user_rate")], F.col("n"), 0.08)
    return _rates(spark, sf_dir).select("g", F.round(rate, 6).alias("rate"))


@query("feature_out_of_range", "SELECT round(max(abs((c_acctbal - 4500.0) / 3000.0)), 6) AS c_acctbal, round(max(abs((c_nationkey - 12.0) / 7.0)), 6) AS c_nationkey FROM customer")
def feature_out_of_range(spark, sf_dir):
    model = uplift.Ridge([4500.0, 12.0], [3000.0, 7.0], [0.0, 0.0], 0.0)
    found = uplift.out_of_range(table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"], model)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


# Gates and holdouts

_ARMS = "sum((treatment = 1)::int) AS treatment_observations, sum((treatment = 0)::int) AS control_observations, sum((treatment = 1 AND outcome = 1)::int) AS positive_treatment_outcomes, sum((treatment = 0 AND outcome = 1)::int) AS positive_control_outcomes"


@query(
    "validation_gate",
    f"SELECT rule FROM (WITH c AS (SELECT count(DISTINCT experiment) AS completed_experiments, {_ARMS} FROM ({_UNITS})) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, {k} < {least} AS failed FROM c" for k, least in policies.VALIDATION_MINIMA.items()) + ") WHERE failed UNION ALL SELECT 'auuc_above_baseline'",
)
def validation_gate(spark, sf_dir):
    """The rules that a model with a Qini of 0.1, but no AUUC above its baseline, fails on these units."""
    units = _units(spark, sf_dir)
    arm, won = F.col("treatment"), F.col("outcome") == 1
    counts = units.agg(
        F.count_distinct("experiment").alias("completed_experiments"),
        F.count_if(arm == 1).alias("treatment_observations"),
        F.count_if(arm == 0).alias("control_observations"),
        F.count_if((arm == 1) & won).alias("positive_treatment_outcomes"),
        F.count_if((arm == 0) & won).alias("positive_control_outcomes"),
    ).first()
    failed = policies.validation_gate(counts.asDict(), {"qini": 0.1, "auuc": 1.0, "auuc_baseline": 1.0})
    return spark.createDataFrame([(f,) for f in failed], "rule string")


@query("experiment_unit_ids", """SELECT c_custkey, 'adunit_' || substr(sha256('{"promotion_run_id":"run-1","user_id":"' || c_custkey || '"}'), 1, 56) AS unit FROM customer""")
def experiment_unit_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", policies.unit_ids(F.lit("run-1"), F.col("c_custkey")).alias("unit"))


_PADS = [bytes(b ^ x for b in b"salt-1".ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]
_HMAC = f"sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode('plan-1' || chr(31) || c_mktsegment || chr(31) || c_custkey))))"


@query("holdout_hmac", f"SELECT c_custkey, CASE WHEN r <= least(greatest(floor(n * 0.7 + 0.5), 1), n - 1) THEN 'treatment' ELSE 'control' END AS arm, key FROM (SELECT c_custkey, {_HMAC} AS key, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_HMAC}, c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def holdout_hmac(spark, sf_dir):
    rows = experiments.holdout(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.7, "salt-1", ("plan-1",))
    return rows.select("c_custkey", "arm", experiments.hmac_key("salt-1", F.lit("plan-1"), F.col("c_mktsegment"), F.col("c_custkey")).alias("key"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """A 95 % interval of the mean outcome, experiments resampled; the driver sees a row for each experiment."""
    sums = _units(spark, sf_dir).groupBy("experiment").agg(F.sum("outcome").cast("double").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("experiment")
    low, high = uplift.cluster_bootstrap([(r["s"], r["n"]) for r in sums.collect()])
    return spark.createDataFrame([(low, high)], "low double, high double")


# Uplift units and temporal backtests

_MANIFEST = """'{"experiment_design":{"mode":"' || CASE WHEN n_nationkey % 5 = 0 THEN 'all' ELSE 'randomized_holdout' END || '"},"outcome_spec":{"uplift_training_eligible":' || CASE WHEN n_nationkey % 7 = 0 THEN 'false' ELSE 'true' END || '}}'"""


@query(
    "uplift_units",
    f"SELECT o_orderkey AS unit, n.n_name AS goal, r_name AS generation_vector_version, s.n_name AS audience_source_cutoff, vec_id IS NOT NULL AS has_vector FROM orders JOIN nation n ON n.n_nationkey = o_orderkey % 25 JOIN region ON r_regionkey = o_orderkey % 6 JOIN nation s ON s.n_nationkey = o_orderkey % 27 LEFT JOIN embeddings ON vec_id = o_custkey AND vec_id % 5 = r_regionkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1997-01-01' AND n.n_nationkey % 4 <> 0 AND n.n_nationkey % 5 <> 0 AND n.n_nationkey % 7 <> 0",
)
def uplift_units(spark, sf_dir):
    """Orders as units, nations as runs, assignments and snapshots, regions as generations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k, key = F.col("o_orderkey"), F.col("n_nationkey")
    units = table(spark, sf_dir, "orders").select(
        k.alias("unit"), F.col("o_orderpriority").alias("project_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("outcome_window_end"), F.col("o_custkey").alias("user_id"),
        (k % 25).alias("promotion_run_id"), (k % 25).alias("segment_assignment_execution_id"), (k % 6).alias("vector_generation_id"), (k % 27).alias("audience_snapshot_id"),
    )
    assignments = nation.select(key.alias("promotion_run_id"), key.alias("segment_assignment_execution_id"), F.when(key % 4 == 0, "open").otherwise("finalized").alias("uplift_assignment_status"), F.lit(None).cast("timestamp_ntz").alias("source_cutoff_at"), F.expr(_MANIFEST).alias("input_manifest_json"))
    runs = nation.select(key.alias("promotion_run_id"), F.col("n_name").alias("goal_snapshot_json"))
    nothing = F.lit(None).cast("string")
    generations = region.select(F.col("r_regionkey").alias("vector_generation_id"), nothing.alias("window_end"), nothing.alias("source_revision_cutoff"), F.col("r_name").alias("vector_version"), nothing.alias("manifest_hash"))
    snapshots = nation.select(key.alias("snapshot_id"), F.col("n_name").alias("source_cutoff"))
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("vector_generation_id"), F.col("vec_id").alias("user_id"), "embedding")
    found = uplift.units(units, assignments, runs, generations, snapshots, vectors, "1-URGENT", datetime(1997, 1, 1))
    return found.select("unit", F.col("goal_snapshot_json").alias("goal"), "generation_vector_version", "audience_source_cutoff", F.col("feature_vector").isNotNull().alias("has_vector"))


_OBSERVED = f"""SELECT user_id, sum(3 + (cnt >= 2 OR is_booking = 1)::int + (cnt >= 4 OR is_booking = 1)::int + is_booking)::bigint AS event_count, count(*) AS hotel_search_count, count(*) FILTER (cnt >= 2 OR is_booking = 1) AS hotel_click_count, count(*) FILTER (cnt >= 4 OR is_booking = 1) AS booking_start_count,
  count(*) FILTER (is_booking = 1) AS booking_complete_count, count(*) FILTER (is_package = 1) AS deal_event_count, list_sort(list(DISTINCT srch_destination_id::varchar))[1:20] AS destination_values,
  list_sort(list(DISTINCT CASE WHEN srch_children_cnt > 0 THEN 'family_travel' WHEN is_package = 1 THEN 'package_travel' WHEN srch_adults_cnt = 1 THEN 'business_or_solo_travel' ELSE 'leisure_travel' END)) AS preferred_category_values,
  count(*) FILTER (srch_destination_id = 7) AS destination_match_count, count(*) FILTER (month(srch_ci) IN (6, 7, 8)) AS season_match_count
  FROM ({_WIDE}) WHERE date_time >= TIMESTAMP '1994-01-01' AND date_time < TIMESTAMP '1997-01-01' GROUP BY user_id"""


def _searches(spark, sf_dir):
    return wide_source(spark, sf_dir).withColumn("hotel_cluster", F.col("hotel_country") % 17)


@query("observed_profiles", _OBSERVED)
def observed_profiles(spark, sf_dir):
    found = backtest.observed_profiles(_searches(spark, sf_dir), "1994-01-01", "1997-01-01", 7, [6, 7, 8])
    return found.select("user_id", "event_count", "hotel_search_count", "hotel_click_count", "booking_start_count", "booking_complete_count", "deal_event_count", "destination_values", "preferred_category_values", "destination_match_count", "season_match_count")


_LATER = f"SELECT DISTINCT user_id FROM ({_WIDE}) WHERE is_booking = 1 AND srch_destination_id = 7 AND month(srch_ci) IN (6, 7, 8) AND date_time >= TIMESTAMP '1997-01-01' AND date_time < TIMESTAMP '1999-01-01'"
_TESTED = {"affinity": "destination_match_count >= 1", "season": "season_match_count > 0", "package": "deal_event_count >= 3"}


@query(
    "temporal_backtest",
    f"WITH k AS (SELECT p.*, user_id IN ({_LATER}) AS won FROM ({_OBSERVED}) p), t AS (SELECT count(*) AS everyone, count(*) FILTER (won) AS n_won FROM k), c AS (" + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER ({c}) AS users, count(*) FILTER (({c}) AND won) AS booked FROM k" for name, c in _TESTED.items()) + ") SELECT name, users, booked, everyone, round(booked / nullif(users, 0), 6) AS actual, round(n_won / everyone, 6) AS baseline, round((booked / nullif(users, 0) - n_won / everyone) * 100, 6) AS lift_pp FROM c, t",
)
def temporal_backtest(spark, sf_dir):
    found = backtest.temporal_backtest(_searches(spark, sf_dir), {name: F.expr(c) for name, c in _TESTED.items()}, "1994-01-01", "1997-01-01", "1999-01-01", 7, [6, 7, 8])
    return found.select("name", "users", "booked", "everyone", *(F.round(c, 6).alias(c) for c in ("actual", "baseline", "lift_pp")))


@query("brier_by_type", f"{_GROUPS} SELECT (g % 2)::int AS kind, round(sum(won * (1 - predicted) * (1 - predicted) + (size - won) * predicted * predicted) / sum(size), 6) AS brier, round(avg(abs(predicted - won / size)), 6) AS mae, round(avg(predicted - won / size), 6) AS bias FROM g GROUP BY kind")
def brier_by_type(spark, sf_dir):
    rows = _groups(spark, sf_dir).withColumn("kind", (F.col("g") % 2).cast("int"))
    found = backtest.brier(rows, F.col("predicted"), F.col("size"), F.col("won"), ["kind"])
    return found.select("kind", *(F.round(c, 6).alias(c) for c in ("brier", "mae", "bias")))
