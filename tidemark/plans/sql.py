"""DuckDB building blocks of the oracle queries."""

from __future__ import annotations

from ..functions.text import DESTINATION_ALIASES
from ..sources.event_log import DESTINATIONS

START, END = "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-25'"


def case(by: str, values: list[str]) -> str:
    return "CASE " + by + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def canonical(expr: str) -> str:
    plain = rf"lower(regexp_replace(trim({expr}), '\s+', ' ', 'g'))"
    whens = " ".join(f"WHEN {plain} IN ({', '.join(repr(n) for n in names)}) THEN '{key}'" for key, names in DESTINATION_ALIASES.items())
    return f"(CASE {whens} ELSE {plain} END)"


#: The event log of tidemark.sources.event_log, with its payload as columns; k is the rule number.
RAW = f"""
k0 AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
raw AS (
  SELECT event_id, ts AS event_time, ts + to_hours(CAST(event_id % 7 AS INT)) AS received_at, CAST(user_id AS VARCHAR) AS user_id,
    CASE WHEN event_id % 50 = 0 THEN 'invalid' ELSE 'valid' END AS validation_status,
    CASE event_type WHEN 'view' THEN {case("k % 3", ["hotel_search", "hotel_detail_view", "hotel_click"])}
      WHEN 'click' THEN {case("k % 4", ["promotion_click", "campaign_landing", "campaign_redirect_click", "promotion_impression"])}
      WHEN 'signup' THEN 'booking_start' WHEN 'purchase' THEN 'booking_complete'
      ELSE {case("k % 2", ["booking_cancel", "page_view"])} END AS event_name,
    {case("k % 4", ["web", "app", "email", "fixture"])} AS source,
    CASE WHEN k % 7 = 0 THEN CAST(k AS VARCHAR) ELSE '' END AS destination_id,
    {case("k % 10", list(DESTINATIONS))} AS destination_name,
    CAST(k % 13 AS VARCHAR) AS hotel_market, CAST(k % 17 AS VARCHAR) AS hotel_cluster,
    CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(k % 45 AS INT) END AS checkin,
    {case("k % 5", ["1", "package_bundle", "true", "", ""])} AS deal,
    CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS free_cancellation, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS breakfast,
    CASE WHEN k % 3 = 0 THEN NULL ELSE floor(value * 4000) END AS price,
    '/p/' || (k % 9) AS page_path, 'exp' || (user_id % 4) AS ad_experiment_id, 'seg' || (user_id % 6) AS segment_id,
    {case("user_id % 4", ["20s", "30s", "40s", ""])} AS age_group, {case("user_id % 3", ["female", "male", ""])} AS gender
  FROM k0),
w AS (
  SELECT *, {canonical("coalesce(nullif(destination_id, ''), nullif(destination_name, ''), '')")} AS destination,
    {canonical("coalesce(nullif(destination_id, ''), nullif(destination_name, ''), hotel_market)")} AS vector_destination,
    lower(concat(destination_id, ' ', destination_name, '  ')) AS destination_text
  FROM raw
  WHERE validation_status = 'valid' AND event_time >= {START} AND event_time < {END} AND received_at <= {END})
"""
