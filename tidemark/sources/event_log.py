"""The raw event log and its typed view.

``raw_events`` derives a booking-site event log from the ``events`` table by
fixed rules; payloads are JSON strings of string values, as any tracker sends
them.  ``typed`` reads the payload once for everything that is computed from it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_KEYS = ("destination_id", "destination_name", "hotel_city", "hotel_country", "hotel_market", "hotel_cluster", "checkin_date", "deal", "free_cancellation", "breakfast_included", "price", "page_path", "promotion_id", "ad_experiment_id", "segment_id", "age_group", "gender", "preferred_category", "promotion_run_id")

DESTINATIONS = ("제주도", " Jeju  Island ", "도쿄", "Seoul", "Da Nang", "okinawa", "Paris", "부산", "", "NEW  york")


def _case(by: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), by + 1)


def raw_events(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """project_id, event_id, event_name, event_time, received_at, source, user_id, properties_json, validation_status.

    If ``placed``, also ``_at``, the event's place in the table: its file and row there.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    place = [F.struct("_metadata.file_path", "_metadata.row_index").alias("_at")] if placed else []
    e = e.select("*", *place)
    k = F.get_json_object("props", "$.k").cast("int")
    kind, k_ = F.col("event_type"), F.col("k")
    part = lambda n: F.pmod(k_, F.lit(n))
    text = lambda c: c.cast("string")
    name = (
        F.when(kind == "view", _case(part(3), ["hotel_search", "hotel_detail_view", "hotel_click"]))
        .when(kind == "click", _case(part(4), ["promotion_click", "campaign_landing", "campaign_redirect_click", "promotion_impression"]))
        .when(kind == "signup", "booking_start")
        .when(kind == "purchase", "booking_complete")
        .otherwise(_case(part(2), ["booking_cancel", "page_view"]))
    )
    payload = {
        "destination_id": F.when(part(7) == 0, text(k_)).otherwise(""),
        "destination_name": _case(part(10), list(DESTINATIONS)),
        "hotel_market": text(part(13)),
        "hotel_cluster": text(part(17)),
        "checkin_date": F.when(part(11) == 0, "").otherwise(F.date_format(F.date_add(F.to_date("ts"), part(45).cast("int")), "yyyy-MM-dd")),
        "deal": _case(part(5), ["1", "package_bundle", "true", "", ""]),
        "free_cancellation": F.when(part(4) == 0, "1").otherwise("0"),
        "breakfast_included": F.when(part(6) == 0, "1").otherwise(""),
        "price": F.when(part(3) == 0, "").otherwise(text(F.floor(F.col("value") * 4000))),
        "page_path": F.concat(F.lit("/p/"), text(part(9))),
        "promotion_id": F.when(kind == "click", "promo1").otherwise(""),
        "ad_experiment_id": F.concat(F.lit("exp"), text(F.pmod("user_id", F.lit(4)))),
        "segment_id": F.concat(F.lit("seg"), text(F.pmod("user_id", F.lit(6)))),
        "promotion_run_id": F.lit("run1"),
        "age_group": _case(F.pmod("user_id", F.lit(4)).cast("int"), ["20s", "30s", "40s", ""]),
        "gender": _case(F.pmod("user_id", F.lit(3)).cast("int"), ["female", "male", ""]),
    }
    pairs = [x for key, value in payload.items() for x in (F.lit(key), value)]
    return e.withColumn("k", k).select(
        F.lit("p1").alias("project_id"),
        "event_id",
        name.alias("event_name"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.pmod("event_id", F.lit(7)).cast("int"))).alias("received_at"),
        _case(part(4), ["web", "app", "email", "fixture"]).alias("source"),
        F.col("user_id").cast("string").alias("user_id"),
        F.to_json(F.create_map(*pairs)).alias("properties_json"),
        F.when(F.pmod("event_id", F.lit(50)) == 0, "invalid").otherwise("valid").alias("validation_status"),
        *(["_at"] if placed else []),
    )


def typed(raw: DataFrame) -> DataFrame:
    """``raw`` with its payload as columns; a missing value is an empty text."""
    p = F.from_json("properties_json", ", ".join(f"{key} string" for key in PAYLOAD_KEYS))
    return raw.withColumn("_p", p).select(*(c for c in raw.columns if c != "properties_json"), *(F.coalesce(F.col(f"_p.{key}"), F.lit("")).alias(key) for key in PAYLOAD_KEYS))


def instant(at: datetime) -> Column:
    """A literal without a time zone, as the event times are."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def shown(at: Column) -> Column:
    """A time to the microsecond as text."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def window(raw: DataFrame, start: datetime | None = None, end: datetime | None = None, received_by: datetime | None = None, project_id: str | None = "p1") -> DataFrame:
    """Valid events with ``start <= event_time < end``, known at ``received_by``; bounds that aren't given don't filter."""
    found = raw.where("validation_status = 'valid'")
    if project_id is not None:
        found = found.where(F.col("project_id") == project_id)
    if start is not None:
        found = found.where(F.col("event_time") >= instant(start))
    if end is not None:
        found = found.where(F.col("event_time") < instant(end))
    if received_by is not None:
        found = found.where(F.col("received_at") <= instant(received_by))
    return found
