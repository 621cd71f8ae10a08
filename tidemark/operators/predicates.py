"""Exact audience predicates: conditions on the events of a user."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import date_or_null, float_or_null, uint8_or_zero
from ..functions.text import canonical_destination, contains_any, list_values, search_terms

INTEREST = ("hotel_search", "hotel_click", "hotel_detail_view")
HARD_PREDICATES = ("hotel_product_interest", "target_destination_affinity", "recent_destination_search", "booking_start_without_complete", "benefit_interest", "promotion_response", "general_destination_exploration", "season_match", "source_audience_membership", "structured_conditions")
PROPERTY_OPERATORS = ("exists", "contains", "in", "gte", "lte", "equals")


def is_event(*names: str) -> Column:
    return F.col("event_name").isin(*names)


def destination_of_event() -> Column:
    """The canonical destination of an event; market and cluster don't stand in for it here."""
    known = F.coalesce(F.nullif("destination_id", F.lit("")), F.nullif("destination_name", F.lit("")), F.nullif("hotel_city", F.lit("")), F.lit(""))
    return canonical_destination(known)


def destination_text() -> Column:
    return F.concat_ws(" ", "destination_id", "destination_name", "hotel_city", "hotel_country")


def flag(key: str) -> Column:
    return uint8_or_zero(F.col(key)) == 1


def has_price() -> Column:
    return F.col("price") != ""


def checkin_month() -> Column:
    return F.month(date_or_null(F.col("checkin_date")))


@dataclass(frozen=True)
class PropertyFilter:
    key: str
    operator: str
    value: str = ""

    def column(self) -> Column:
        own = F.col(self.key)
        if self.operator == "exists":
            return own != ""
        if self.operator == "contains":
            return F.instr(F.lower(own), self.value.lower()) > 0
        if self.operator == "in":
            return F.lower(own).isin(list_values(self.value))
        if self.operator in ("gte", "lte"):
            number, bound = float_or_null(F.nullif(own, F.lit(""))), float(self.value)
            return F.coalesce(number >= bound if self.operator == "gte" else number <= bound, F.lit(False))
        if self.operator != "equals":
            raise ValueError(f"unknown property operator: {self.operator}")
        if self.key in ("free_cancellation", "breakfast_included"):
            wanted = {"true": "1", "false": "0"}.get(self.value.lower(), self.value)
            return uint8_or_zero(own) == uint8_or_zero(F.lit(wanted))
        return F.lower(own) == self.value.lower()


@dataclass(frozen=True)
class Condition:
    """So many events of a name, at some destination, in some check-in months, with some properties."""

    event_name: str
    minimum: int = 1
    maximum: int | None = None
    destination: str = ""
    checkin_months: Sequence[int] = ()
    properties: Sequence[PropertyFilter] = ()

    def event_match(self) -> Column:
        parts = [is_event(self.event_name)]
        if self.destination:
            parts.append(contains_any(destination_text(), search_terms(self.destination)))
        if self.checkin_months:
            parts.append(F.coalesce(checkin_month().isin(*self.checkin_months), F.lit(False)))
        return reduce(lambda a, b: a & b, [*parts, *(p.column() for p in self.properties)])

    def within(self, count: Column) -> Column:
        return (count >= self.minimum) & (F.lit(True) if self.maximum is None else count <= self.maximum)


@dataclass(frozen=True)
class Request:
    """A named conjunction of hard predicates and their parameters."""

    name: str
    keys: Sequence[str]
    destinations: Sequence[str] = ()
    benefits: Sequence[str] = ()
    months: Sequence[int] = ()
    conditions: Sequence[Condition] = field(default_factory=tuple)


def _aggregates(request: Request) -> dict[str, Column]:
    """Per predicate key, what must hold for a user's group of events."""
    unknown = sorted(set(request.keys) - set(HARD_PREDICATES))
    if unknown:
        raise ValueError("unknown hard predicates: " + ", ".join(unknown))
    count = lambda c: F.count_if(c)
    at = F.col("_destination").isin(*request.destinations) if request.destinations else F.lit(False)
    benefit = {
        "discount": flag("deal") | has_price(),
        "early_booking": flag("deal") | has_price(),
        "free_cancellation": flag("free_cancellation"),
        "breakfast_included": flag("breakfast_included"),
    }
    any_benefit = flag("deal") | flag("free_cancellation") | flag("breakfast_included") | has_price()
    wanted = [benefit[b] for b in request.benefits if b in benefit]
    interest = count(reduce(lambda a, b: a | b, wanted)) if wanted else count(F.lit(False) if request.benefits else any_benefit)
    all_of = {
        "hotel_product_interest": count(is_event(*INTEREST)) > 0,
        "target_destination_affinity": count(at) >= 2,
        "recent_destination_search": count(at) > 0,
        "booking_start_without_complete": count(is_event("booking_start")) > count(is_event("booking_complete")),
        "benefit_interest": interest > 0,
        "promotion_response": count(is_event("promotion_click", "campaign_landing")) > 0,
        "general_destination_exploration": F.count_distinct(F.when(is_event(*INTEREST) & (F.col("_destination") != ""), F.col("_destination"))) >= 2,
        "season_match": count(checkin_month().isin(*request.months) if request.months else F.lit(False)) > 0,
        "source_audience_membership": F.lit(True),
        "structured_conditions": reduce(lambda a, b: a & b, [c.within(count(c.event_match())) for c in request.conditions], F.lit(True)),
    }
    return {k: all_of[k] for k in request.keys}


def matching_users(events: DataFrame, request: Request, population: DataFrame | None = None) -> DataFrame:
    """user_id of everyone whose events meet all predicates; ``population`` (user_id) narrows the search before grouping."""
    rows = events.join(population.select("user_id").distinct(), "user_id", "left_semi") if population is not None else events
    rows = rows.withColumn("_destination", destination_of_event())
    holds = reduce(lambda a, b: a & b, _aggregates(request).values(), F.lit(True))
    return rows.groupBy("user_id").agg(holds.alias("_holds")).where("_holds").select("user_id")


def batch_match_counts(events: DataFrame, requests: Sequence[Request]) -> DataFrame:
    """name and users of each request, from one pass: a row of verdicts per user, then one count per request."""
    rows = events.withColumn("_destination", destination_of_event())
    verdicts = rows.groupBy("user_id").agg(*(reduce(lambda a, b: a & b, _aggregates(r).values(), F.lit(True)).alias(f"_{i}") for i, r in enumerate(requests)))
    counts = verdicts.agg(*(F.count_if(f"_{i}").alias(f"_{i}") for i in range(len(requests))))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r.name).alias("name"), F.col(f"_{i}").alias("users")) for i, r in enumerate(requests)))).alias("r")).select("r.*")


def condition_match_counts(events: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Per user, how many of the conditions hold (0 to all)."""
    held = [F.when(c.within(F.count_if(c.event_match())), 1).otherwise(0) for c in conditions]
    return events.groupBy("user_id").agg(reduce(lambda a, b: a + b, held).cast("long").alias("matches"))


def profile_array_match(values: Column, terms: Sequence[str]) -> Column:
    """The same test on a profile's list of values: whether any holds any term."""
    return F.exists(values, lambda v: contains_any(v, terms))


# What a condition on a property may name, and the spellings of its values.
CONDITION_EVENTS = ("page_view", "hotel_search", "hotel_click", "hotel_detail_view", "promotion_impression", "promotion_click", "campaign_redirect_click", "campaign_landing", "booking_start", "booking_complete", "booking_cancel")
CONDITION_KEYS = (
    "deal", "free_cancellation", "breakfast_included", "age_group", "gender", "region", "preferred_category", "user_segment", "adult_count", "child_count", "rooms", "hotel_id", "hotel_name", "hotel_city", "hotel_country",
    "hotel_market", "hotel_cluster", "hotel_star_rating", "hotel_guest_rating", "price", "property_type", "room_type", "revenue",
)
CONDITION_OPERATORS = ("equals", "in", "contains", "exists", "gte", "lte")
TRUE_WORDS, FALSE_WORDS = ("1", "true", "yes", "y", "예", "있음"), ("0", "false", "no", "n", "아니오", "없음")
TWENTIES, THIRTIES = ("20", "20-29", "20대", "20s"), ("30", "30-39", "30대", "30s")
GENDERS = (("m", "male", "남", "남성"), ("f", "female", "여", "여성"))
MOST_CONDITIONS, MOST_REPEATS = 6, 100


@dataclass(frozen=True, order=True)
class PropertyCondition:
    """At least ``minimum`` events of a kind with a property."""

    event: str
    key: str
    operator: str
    value: str
    minimum: int = 1

    def condition(self) -> Condition:
        return Condition(self.event, self.minimum, properties=(PropertyFilter(self.key, self.operator, self.value),))


def _number(value: str) -> str:
    try:
        return format(Decimal(value).normalize(), "f")
    except InvalidOperation:
        raise ValueError("invalid_numeric_value") from None


def _truth(value: str) -> str:
    for word, spellings in (("true", TRUE_WORDS), ("false", FALSE_WORDS)):
        if value in spellings:
            return word
    raise ValueError("invalid_boolean_value")


def _choice(value: str, groups: Sequence[Sequence[Sequence[str]]]) -> str:
    """The listed values; a group stands whole for itself where each of its parts has a spelling among them."""
    values = list_values(value)
    whole = next((g for g in groups if all(set(part) & set(values) for part in g)), None)
    return ",".join(v for part in whole for v in part) if whole else ",".join(values)


def _spelling(key: str, operator: str) -> Callable[[str], str]:
    """How the value of such a condition is written."""
    if operator in ("gte", "lte"):
        return _number
    if key in ("free_cancellation", "breakfast_included"):
        return _truth
    groups = {"age_group": [[TWENTIES, THIRTIES]], "gender": [[g] for g in GENDERS]}.get(key, [])
    return (lambda value: _choice(value, groups)) if operator == "in" else str


def _canonical_value(key: str, operator: str, given: Any) -> str:
    if operator == "exists":
        return "true"
    value = " ".join(str(given or "").split()).casefold()
    try:
        spelt = _spelling(key, operator)(value) if value else ""
    except ValueError as wrong:
        raise ValueError(f"{wrong}:{key}") from None
    if not spelt:
        raise ValueError(f"missing_value:{key}")
    return spelt


def canonical_conditions(given: Any) -> tuple[list[PropertyCondition], list[str]]:
    """Conditions in one order and spelling without repeats, and why others aren't supported.

    Of a list only the first ``MOST_CONDITIONS`` are read, as the feature allows
    no more.  Lists of values are split and sorted, spellings of an age group or
    gender become all of them, numbers lose what doesn't change them.
    """
    if given is None:
        return [], []
    if not isinstance(given, (list, tuple)):
        return [], ["property_condition:invalid_array"]
    found: set[PropertyCondition] = set()
    refused: dict[str, None] = {}
    for item in given[:MOST_CONDITIONS]:
        try:
            if not isinstance(item, Mapping):
                raise ValueError("invalid_item")
            names = {}
            for what, allowed in (("event_name", CONDITION_EVENTS), ("property_key", CONDITION_KEYS), ("operator", CONDITION_OPERATORS)):
                names[what] = str(item.get(what, "")).strip()
                if names[what] not in allowed:
                    raise ValueError(f"unsupported_{what.split('_')[0]}:{names[what] or 'missing'}")
            try:
                least = int(item.get("minimum_count", 1))
            except (TypeError, ValueError):
                least = 0
            if not 1 <= least <= MOST_REPEATS:
                raise ValueError("invalid_minimum_count")
            key, operator = names["property_key"], names["operator"]
            found.add(PropertyCondition(names["event_name"], key, operator, _canonical_value(key, operator, item.get("value")), least))
        except ValueError as wrong:
            refused[f"property_condition:{wrong}"] = None
    return sorted(found), list(refused)
