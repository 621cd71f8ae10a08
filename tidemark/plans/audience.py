"""Event-log and audience queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.hashing import row_checksums, signed_coordinate, stable_bucket
from ..functions.text import canonical_destination, contains_any
from ..operators.predicates import INTEREST, Condition, PropertyFilter, Request, batch_match_counts, condition_match_counts, destination_text, matching_users
from ..sources.event_log import raw_events, shown, typed, window
from .sql import RAW, canonical

START, END = datetime(2024, 1, 5), datetime(2024, 1, 25)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle if oracle.lstrip().startswith("WITH") else oracle
        return f

    return add


def scoped(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """The typed events of the observation window that were known at its end."""
    return typed(window(raw_events(spark, sf_dir, placed), START, END, END))


def with_raw(select: str) -> str:
    return f"WITH {RAW} {select}"


@query("scan_window_filter", with_raw("SELECT event_id, user_id, event_name FROM w"))
def scan_window_filter(spark, sf_dir):
    return scoped(spark, sf_dir).select("event_id", "user_id", "event_name")


@query("source_stats", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS bookings, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM events")
def source_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("bookings"), shown(F.min("ts")).alias("first_at"), shown(F.max("ts")).alias("last_at"))


@query(
    "source_checksum",
    "SELECT (sum(h::HUGEINT) % (1::HUGEINT << 60))::bigint AS checksum_sum, bit_xor(h) AS checksum_xor FROM (SELECT ('0x' || substr(md5(concat_ws('|', event_id, user_id, event_type)), 1, 15))::bigint AS h FROM events)",
)
def source_checksum(spark, sf_dir):
    total, xor = row_checksums(F.col("event_id"), F.col("user_id"), F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(total.alias("checksum_sum"), xor.alias("checksum_xor"))


@query("event_summary", with_raw("SELECT event_name, count(*) AS n_events, count(DISTINCT user_id) AS users, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM raw GROUP BY event_name"))
def event_summary(spark, sf_dir):
    return raw_events(spark, sf_dir).groupBy("event_name").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("users"), shown(F.min("event_time")).alias("first_at"), shown(F.max("event_time")).alias("last_at"))


@query("optional_bounds", with_raw(f"SELECT count(*) AS n_events FROM raw WHERE validation_status = 'valid' AND event_time >= TIMESTAMP '2024-01-05'"))
def optional_bounds(spark, sf_dir):
    return window(raw_events(spark, sf_dir), start=START).agg(F.count(F.lit(1)).alias("n_events"))


@query("hash_sample_users", "SELECT DISTINCT user_id FROM events WHERE ('0x' || substr(sha256(user_id::varchar), 1, 16))::UBIGINT % 5 = 2")
def hash_sample_users(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where(stable_bucket(F.col("user_id").cast("string"), 5) == 2).select("user_id").distinct()


@query("stable_bucket", "SELECT c_custkey, (('0x' || substr(sha256(c_custkey::varchar), 1, 16))::UBIGINT % 100)::int AS bucket FROM customer")
def stable_bucket_query(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", stable_bucket(F.col("c_custkey").cast("string"), 100).alias("bucket"))


@query(
    "signed_hash_coordinate",
    "SELECT DISTINCT lang, (('0x' || substr(sha256(lang), 1, 16))::UBIGINT % 16)::int AS bucket, CASE WHEN ('0x' || substr(sha256(lang), 17, 2))::int % 2 = 1 THEN -1.0::double ELSE 1.0::double END AS sign FROM (SELECT lang || ':' || source AS lang FROM documents)",
)
def signed_hash_coordinate(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws(":", "lang", "source").alias("lang")).distinct()
    bucket, sign = signed_coordinate(F.col("lang"))
    return names.select("lang", bucket.alias("bucket"), sign.alias("sign"))


@query("canonical_destination", with_raw(f"SELECT destination_name, {canonical('destination_name')} AS destination, count(*) AS n_events FROM raw GROUP BY ALL"))
def canonical_destination_query(spark, sf_dir):
    return typed(raw_events(spark, sf_dir)).groupBy("destination_name", canonical_destination(F.col("destination_name")).alias("destination")).agg(F.count(F.lit(1)).alias("n_events"))


@query("contains_any_term", with_raw("SELECT user_id, count(*) AS n_events FROM w WHERE contains(destination_text, 'jeju') OR contains(destination_text, '제주') OR contains(destination_text, 'new') GROUP BY user_id"))
def contains_any_term(spark, sf_dir):
    return scoped(spark, sf_dir).where(contains_any(destination_text(), ["Jeju", "제주", "NEW"])).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))


@query("split_values", "SELECT s_suppkey, ['busan', 'seoul', lower(s_name), '차이나타운'] AS parts FROM supplier")
def split_values_query(spark, sf_dir):
    from ..functions.text import split_values

    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", split_values(F.concat(F.lit("Seoul ，BUSAN또는"), "s_name", F.lit("/ ·seoul혹은차이나타운"))).alias("parts"))


@query("json_extract", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events")
def json_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("json_projection", with_raw("SELECT event_id, '{\"destination\":\"' || destination_id || '\",\"market\":\"' || hotel_market || '\"}' AS payload FROM raw"))
def json_projection(spark, sf_dir):
    t = typed(raw_events(spark, sf_dir))
    return t.select("event_id", F.to_json(F.create_map(F.lit("destination"), "destination_id", F.lit("market"), "hotel_market")).alias("payload"))


@query("json_array_explode", "SELECT o_orderkey, unnest(['a', 'b', o_orderstatus]) AS item, unnest([0, 1, 2]) AS position, 3 = len(list_distinct(['a', 'b', o_orderstatus])) AS all_distinct FROM orders")
def json_array_explode(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    doc = orders.select("o_orderkey", F.to_json(F.struct(F.array(F.lit("a"), F.lit("b"), "o_orderstatus").alias("items"))).alias("doc"))
    items = F.from_json("doc", "items array<string>")["items"]
    rows = doc.select("o_orderkey", items.alias("items"))
    return rows.select("o_orderkey", (F.size("items") == F.size(F.array_distinct("items"))).alias("all_distinct"), F.posexplode("items").alias("position", "item"))


@query("json_approval_filter", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 1 AND s_suppkey % 2 = 0")
def json_approval_filter(spark, sf_dir):
    """Missing approval counts as given; the channel must be in the list."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    approved = F.when(key % 3 == 1, '"approved":false,').when(key % 3 == 2, '"approved":true,').otherwise("")
    channels = F.when(key % 2 == 0, '["email","sms"]').otherwise('["push"]')
    doc = s.select("s_suppkey", F.concat(F.lit("{"), approved, F.lit('"channels":'), channels, F.lit("}")).alias("doc"))
    ok = F.coalesce(F.get_json_object("doc", "$.approved"), F.lit("true")) == "true"
    return doc.where(ok & F.array_contains(F.from_json(F.get_json_object("doc", "$.channels"), "array<string>"), "email")).select("s_suppkey")


@query("safe_cast", with_raw("SELECT deal, CASE WHEN deal = '1' THEN 1 ELSE 0 END AS deal_flag, CASE WHEN deal = '1' THEN 1.0::double END AS deal_number, count(*) AS n_events FROM raw GROUP BY ALL"))
def safe_cast(spark, sf_dir):
    t = typed(raw_events(spark, sf_dir))
    return t.groupBy("deal", safe.uint8_or_zero(F.col("deal")).alias("deal_flag"), safe.float_or_null(F.col("deal")).alias("deal_number")).agg(F.count(F.lit(1)).alias("n_events"))


@query(
    "season_share",
    with_raw("SELECT user_id, round(count(*) FILTER (month(checkin) IN (12, 1, 2)) / count(checkin), 6) AS winter, round(count(*) FILTER (isodow(checkin) IN (6, 7)) / count(checkin), 6) AS weekend FROM w GROUP BY user_id"),
)
def season_share(spark, sf_dir):
    day = safe.date_or_null(F.col("checkin_date"))
    rows = scoped(spark, sf_dir).select("user_id", day.alias("day"))
    share = lambda c: F.round(F.count_if(c) / F.count("day"), 6)
    return rows.groupBy("user_id").agg(share(F.month("day").isin(12, 1, 2)).alias("winter"), share(F.weekday("day").isin(5, 6)).alias("weekend"))


@query(
    "lead_time_bucket",
    with_raw("SELECT CASE WHEN d BETWEEN 0 AND 7 THEN '0_7' WHEN d BETWEEN 8 AND 30 THEN '8_30' WHEN d > 30 THEN 'gt_30' ELSE 'none' END AS bucket, count(*) AS n_events FROM (SELECT datediff('day', event_time::date, checkin) AS d FROM w) GROUP BY ALL"),
)
def lead_time_bucket(spark, sf_dir):
    days = F.date_diff(safe.date_or_null(F.col("checkin_date")), F.to_date("event_time"))
    bucket = F.when(days.between(0, 7), "0_7").when(days.between(8, 30), "8_30").when(days > 30, "gt_30").otherwise("none")
    return scoped(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_events"))


@query("array_hof", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_sum(list_transform(embedding, lambda x: abs(x::double))), 6) AS l1, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS any_large FROM embeddings")
def array_hof(spark, sf_dir):
    v = F.col("embedding")
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    l1 = F.aggregate(F.transform(v, lambda x: F.abs(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(l1, 6).alias("l1"), F.exists(v, lambda x: x > F.lit(0.3).cast("float")).alias("any_large"))


# Hard predicates

CONDITIONS = (
    Condition("hotel_detail_view", 2, 40, "jeju", (1, 2), (PropertyFilter("price", "gte", "1000"),)),
    Condition("booking_start", 1, None),
)
REQUESTS = {
    "hotel_product_interest": Request("hotel_product_interest", ["hotel_product_interest"]),
    "target_destination_affinity": Request("target_destination_affinity", ["target_destination_affinity"], destinations=["jeju", "seoul"]),
    "recent_destination_search": Request("recent_destination_search", ["recent_destination_search"], destinations=["paris"]),
    "booking_start_without_complete": Request("booking_start_without_complete", ["booking_start_without_complete"]),
    "benefit_interest": Request("benefit_interest", ["benefit_interest"], benefits=["free_cancellation"]),
    "promotion_response": Request("promotion_response", ["promotion_response"]),
    "general_destination_exploration": Request("general_destination_exploration", ["general_destination_exploration"]),
    "season_match": Request("season_match", ["season_match"], months=[3]),
    "structured_conditions": Request("structured_conditions", ["structured_conditions"], conditions=CONDITIONS),
    "all": Request("all", ["hotel_product_interest", "benefit_interest", "promotion_response"]),
}
_INTEREST = "event_name IN ('hotel_search', 'hotel_click', 'hotel_detail_view')"
_HAVING = {
    "hotel_product_interest": f"count(*) FILTER ({_INTEREST}) > 0",
    "target_destination_affinity": "count(*) FILTER (destination IN ('jeju', 'seoul')) >= 2",
    "recent_destination_search": "count(*) FILTER (destination = 'paris') > 0",
    "booking_start_without_complete": "count(*) FILTER (event_name = 'booking_start') > count(*) FILTER (event_name = 'booking_complete')",
    "benefit_interest": "count(*) FILTER (free_cancellation = 1) > 0",
    "promotion_response": "count(*) FILTER (event_name IN ('promotion_click', 'campaign_landing')) > 0",
    "general_destination_exploration": f"count(DISTINCT destination) FILTER ({_INTEREST} AND destination <> '') >= 2",
    "season_match": "count(*) FILTER (month(checkin) = 3) > 0",
    "structured_conditions": "count(*) FILTER (event_name = 'hotel_detail_view' AND (contains(destination_text, 'jeju') OR contains(destination_text, '제주')) AND month(checkin) IN (1, 2) AND price >= 1000) BETWEEN 2 AND 40 AND count(*) FILTER (event_name = 'booking_start') >= 1",
    "all": f"count(*) FILTER ({_INTEREST}) > 0 AND count(*) FILTER (deal = '1' OR free_cancellation = 1 OR breakfast = 1 OR price IS NOT NULL) > 0 AND count(*) FILTER (event_name IN ('promotion_click', 'campaign_landing')) > 0",
}


def _hard(name: str) -> None:
    @query(f"hard_predicate_{name}", with_raw(f"SELECT user_id FROM w GROUP BY user_id HAVING {_HAVING[name]}"))
    def run(spark, sf_dir):
        return matching_users(scoped(spark, sf_dir), REQUESTS[name])


for _name in REQUESTS:
    _hard(_name)


@query("hard_predicate_source_audience_membership", with_raw("SELECT user_id FROM w WHERE user_id::bigint % 3 = 0 GROUP BY user_id"))
def source_membership(spark, sf_dir):
    base = raw_events(spark, sf_dir).where(F.col("user_id").cast("long") % 3 == 0).select("user_id")
    return matching_users(scoped(spark, sf_dir), Request("source", ["source_audience_membership"]), base)


@query("source_refinement", with_raw(f"SELECT user_id FROM w WHERE user_id::bigint % 3 = 0 GROUP BY user_id HAVING {_HAVING['structured_conditions']}"))
def source_refinement(spark, sf_dir):
    base = raw_events(spark, sf_dir).where(F.col("user_id").cast("long") % 3 == 0).select("user_id")
    return matching_users(scoped(spark, sf_dir), REQUESTS["structured_conditions"], base)


@query("batch_hard_match", with_raw(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS users FROM (SELECT user_id FROM w GROUP BY user_id HAVING {_HAVING[n]})" for n in REQUESTS)))
def batch_hard_match(spark, sf_dir):
    return batch_match_counts(scoped(spark, sf_dir), list(REQUESTS.values()))


@query(
    "structured_condition_count",
    with_raw("SELECT user_id, count(*) FILTER (event_name = 'hotel_detail_view' AND (contains(destination_text, 'jeju') OR contains(destination_text, '제주')) AND month(checkin) IN (1, 2) AND price >= 1000) AS n_events FROM w GROUP BY user_id"),
)
def structured_condition_count(spark, sf_dir):
    return scoped(spark, sf_dir).groupBy("user_id").agg(F.count_if(CONDITIONS[0].event_match()).alias("n_events"))


_PROPERTY = {
    "exists": (PropertyFilter("deal", "exists"), "deal <> ''"),
    "contains": (PropertyFilter("deal", "contains", "BUNDLE"), "contains(deal, 'bundle')"),
    "in": (PropertyFilter("deal", "in", "True, 1"), "deal IN ('true', '1')"),
    "gte": (PropertyFilter("price", "gte", "200000"), "price >= 200000"),
    "lte": (PropertyFilter("price", "lte", "50000"), "price <= 50000"),
    "equals": (PropertyFilter("free_cancellation", "equals", "true"), "free_cancellation = 1"),
}


def _property(name: str) -> None:
    @query(f"property_{name}", with_raw(f"SELECT user_id, count(*) FILTER ({_PROPERTY[name][1]}) AS n_events FROM w GROUP BY user_id"))
    def run(spark, sf_dir):
        return scoped(spark, sf_dir).groupBy("user_id").agg(F.count_if(_PROPERTY[name][0].column()).alias("n_events"))


for _name in _PROPERTY:
    _property(_name)


@query(
    "property_match_count",
    with_raw("SELECT user_id, (CASE WHEN count(*) FILTER (event_name = 'hotel_search' AND price >= 200000) >= 2 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (event_name = 'booking_start' AND deal <> '') >= 3 THEN 1 ELSE 0 END)::bigint AS matches FROM w GROUP BY user_id"),
)
def property_match_count(spark, sf_dir):
    return condition_match_counts(scoped(spark, sf_dir), [Condition("hotel_search", 2, properties=(_PROPERTY["gte"][0],)), Condition("booking_start", 3, properties=(_PROPERTY["exists"][0],))])


@query("count_distinct_if", with_raw(f"SELECT count(DISTINCT user_id) FILTER (event_name = 'booking_complete') AS bookers, count(DISTINCT destination) FILTER ({_INTEREST}) AS destinations FROM w"))
def count_distinct_if(spark, sf_dir):
    from ..operators.predicates import destination_of_event, is_event

    rows = scoped(spark, sf_dir).withColumn("destination", destination_of_event())
    return rows.agg(F.count_distinct(F.when(is_event("booking_complete"), F.col("user_id"))).alias("bookers"), F.count_distinct(F.when(is_event(*INTEREST), F.col("destination"))).alias("destinations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who started more bookings than they completed, with their counts, most starts first."""
    rows = scoped(spark, sf_dir)
    counts = rows.groupBy("user_id").agg(F.count_if(F.col("event_name") == "booking_start").alias("starts"), F.count_if(F.col("event_name") == "booking_complete").alias("completes"))
    return counts.where("starts > completes").orderBy(F.desc("starts"), "user_id")


QUERIES["abandoned_bookings"] = flagship
ORACLES["abandoned_bookings"] = with_raw("SELECT user_id, count(*) FILTER (event_name = 'booking_start') AS starts, count(*) FILTER (event_name = 'booking_complete') AS completes FROM w GROUP BY user_id HAVING starts > completes")
