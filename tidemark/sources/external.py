"""Adapters of three kinds of public travel and shop data to profiles and outcomes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import first_eight, stable_bucket
from .files import read_zipped_csv


@dataclass(frozen=True)
class Sampling:
    """Which subjects take part: one stable bucket of ``modulo``, and the ``most`` smallest hashes of those."""

    modulo: int = 1
    remainder: int = 0
    most: int = 10_000

    def subjects(self, rows: DataFrame, key: str) -> DataFrame:
        own = rows.select(key).distinct().where(stable_bucket(F.col(key).cast("string"), self.modulo) == self.remainder)
        return own.orderBy(first_eight(F.col(key).cast("string")), key).limit(self.most)


def _has(c: Column, *values: str) -> Column:
    return F.lower(F.trim(c)).isin(*values)


def trips(spark: SparkSession, path: str, sampling: Sampling, truth: str | None = None) -> DataFrame:
    """trip_id, cities (visited before), outcome (the next city), from an itinerary CSV.

    The last city of a trip is its outcome, unless a file with the true next
    cities is given; then all of the trip is observed.  A trip is ordered by
    check-in and check-out, equal stays by their place in the file.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = {"utrip_id", "city_id", "checkin", "checkout"} - set(rows.columns)
    if missing:
        raise ValueError(f"{path} lacks {sorted(missing)}")
    # where a row stands: its file, the block that a task read, and the place in it
    rows = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    unknown = [""] if truth is None else ["", "0"]
    rows = rows.join(sampling.subjects(rows, "utrip_id"), "utrip_id", "left_semi").where(~F.coalesce("city_id", F.lit("")).isin(unknown))
    stays = rows.groupBy("utrip_id").agg(F.sort_array(F.collect_list(F.struct("checkin", "checkout", "_at", "city_id"))).alias("s"))
    cities = F.transform("s", lambda x: x["city_id"])
    if truth is None:
        n = F.size("s")
        known = stays.where(n >= 2).select(F.col("utrip_id").alias("trip_id"), F.slice(cities, F.lit(1), n - 1).alias("cities"), F.element_at(cities, -1).alias("outcome"))
        return known
    answers = spark.read.option("header", True).csv(truth).select(F.col("utrip_id").alias("trip_id"), F.col("city_id").alias("outcome"))
    return stays.select(F.col("utrip_id").alias("trip_id"), cities.alias("cities")).join(answers, "trip_id")


def top_cities(visits: DataFrame, minimum_users: int, most: int) -> DataFrame:
    """Cities that enough trips observed, the most visited first."""
    seen = visits.select("trip_id", F.explode(F.array_distinct("cities")).alias("city"))
    return seen.groupBy("city").agg(F.count(F.lit(1)).alias("users")).where(F.col("users") >= minimum_users).orderBy(F.desc("users"), "city").limit(most)


# Session actions that already are the outcome, and those that show a listing.
OUTCOME_ACTIONS = ("booking_request", "booking_response")
DETAIL_ACTIONS = ("show", "lookup")
DETAIL_DETAILS = ("p3", "view_listing", "view_search_results")


def sessions(spark: SparkSession, users_zip: str, sessions_zip: str, sampling: Sampling) -> DataFrame:
    """Profiles of users from zipped session logs, with booked (whether their destination is known); actions that are outcomes are left out."""
    users = read_zipped_csv(spark, users_zip, "train_users_2.csv", ["id", "country_destination", "age", "gender", "affiliate_channel"])
    log = read_zipped_csv(spark, sessions_zip, "sessions.csv", ["user_id", "action", "action_type", "action_detail"])
    users = users.join(sampling.subjects(users, "id"), "id", "left_semi")
    seen = log.where(~F.coalesce(_has(F.col("action_type"), *OUTCOME_ACTIONS), F.lit(False)))
    hit = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    action, detail = F.lower(F.trim("action")), F.col("action_detail")
    counts = seen.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("event_count"),
        hit(action.contains("search") | _has(detail, "view_search_results")).alias("hotel_search_count"),
        hit(_has(F.col("action_type"), "click")).alias("hotel_click_count"),
        hit(action.isin(*DETAIL_ACTIONS) | F.coalesce(_has(detail, *DETAIL_DETAILS), F.lit(False))).alias("hotel_detail_view_count"),
    )
    age = F.col("age").try_cast("double")
    group = F.when(age.between(20, 29), "20s").when(age.between(30, 39), "30s").when(age.between(40, 49), "40s").otherwise("")
    return users.join(counts, "id").select(F.col("id").alias("user_id"), "event_count", "hotel_search_count", "hotel_click_count", "hotel_detail_view_count", group.alias("age_group"), F.lower("gender").alias("gender"), "affiliate_channel", (F.coalesce("country_destination", F.lit("NDF")) != "NDF").alias("booked"))


def commerce(spark: SparkSession, folder: str, sampling: Sampling, start: str, cutoff: str, end: str) -> DataFrame:
    """Per client, searches, cart changes, purchases and categories in [start, cutoff) and whether they buy in [cutoff, end).

    The tables are search_query, add_to_cart, remove_from_cart, product_buy
    (client_id, timestamp as text, sku) and product_properties (sku, category).
    """

    def events(name: str, kind: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        sku = F.col("sku") if "sku" in rows.columns else F.lit(None).cast("long")
        return rows.select("client_id", F.col("timestamp").try_cast("timestamp_ntz").alias("at"), sku.alias("sku"), F.lit(kind).alias("kind"))

    at = lambda t: F.lit(t).cast("timestamp_ntz")
    every = events("search_query", "search").unionAll(events("add_to_cart", "add")).unionAll(events("remove_from_cart", "remove")).unionAll(events("product_buy", "buy"))
    before = every.where((F.col("at") >= at(start)) & (F.col("at") < at(cutoff)))
    before = before.join(sampling.subjects(before, "client_id"), "client_id", "left_semi")
    categories = spark.read.parquet(f"{folder}/product_properties.parquet").select("sku", "category")
    profile = before.join(categories, "sku", "left").groupBy("client_id").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("search", "add", "remove", "buy")), F.slice(F.sort_array(F.collect_set("category")), 1, 20).alias("categories"))
    later = every.where((F.col("kind") == "buy") & (F.col("at") >= at(cutoff)) & (F.col("at") < at(end))).select("client_id").distinct().withColumn("_b", F.lit(True))
    return profile.join(later, "client_id", "left").withColumn("bought", F.coalesce("_b", F.lit(False))).drop("_b")
