"""Beam search over behaviours: audiences that stand on what a promotion demands.

Everything that grows with the users is aggregated in Spark: one pass gives the
sizes of all anchors, one the counts of all candidates of a level, one the sizes
of their intersections.  The driver sees at most ``Policy.generated`` candidates.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Of each behaviour its dimension, the counts that show it (an exact one first, if profiles have it) and the least counts tried.
BEHAVIOURS = {
    "destination_repeat_search": ("destination_affinity", ("target_destination_search_count", "destination_match_count"), (2, 3)),
    "hotel_detail_view": ("consideration", ("hotel_detail_view_count",), (1, 2)),
    "booking_start": ("funnel", ("booking_start_count",), (1,)),
    "booking_start_without_complete": ("funnel", ("booking_start_count",), (1,)),
    "price_compare": ("value", ("price_search_count", "price_event_count"), (1, 2)),
    "discount_interest": ("value", ("deal_search_count", "deal_event_count"), (1,)),
    "free_cancellation_interest": ("benefit", ("free_cancellation_search_count", "free_cancellation_count"), (1,)),
    "breakfast_interest": ("benefit", ("breakfast_search_count", "breakfast_included_count"), (1,)),
    "promotion_click": ("promotion_response", ("promotion_click_count",), (1,)),
    "campaign_landing": ("promotion_response", ("campaign_landing_count",), (1,)),
}
UNFINISHED = "booking_start_without_complete"
EXCLUSIVE = ({"booking_start", UNFINISHED},)
INTENT = {"funnel": 0.95, "destination_affinity": 0.92, "consideration": 0.82, "value": 0.78, "benefit": 0.76, "promotion_response": 0.62}
ALIGNED = ("funnel", "value", "benefit")
NO_CHOICE_INTENT = 0.45
BOOKING = {"hotel_detail_view": 0.35, "booking_start": 0.45, "booking_complete": 0.20}
SCORE = {"promotion_alignment": 0.22, "behavior_intent": 0.18, "sample_reliability": 0.14, "expected_booking": 0.24, "audience_reach": 0.10, "distinctiveness": 0.12}
EXTRA_CHOICE, SMALL_SAMPLE, OVERLAP = 0.04, 0.15, 0.12
MOST_CONDITIONS = 8

Choice = tuple[str, int]


@dataclass(frozen=True)
class Policy:
    width: int = 8
    depth: int = 1
    generated: int = 50
    final: int = 3
    similarity: float = 0.85


@dataclass(frozen=True)
class Demand:
    """What a promotion demands of everyone: a destination, a season, and conditions on properties by their key."""

    destination: bool = False
    season: bool = False
    properties: dict[str, Column] = field(default_factory=dict)
    #: keys that may be given up when too few users are left
    relaxable: frozenset[str] = frozenset({"age_group", "gender"})


@dataclass(frozen=True)
class Candidate:
    choices: tuple[Choice, ...]
    users: int
    score: float

    @property
    def name(self) -> str:
        return "beam_" + "__".join(f"{k}_{n}" for k, n in self.choices) if self.choices else "beam_property_anchor"

    @property
    def rank(self) -> tuple:
        return -self.score, -self.users, self.choices


@dataclass(frozen=True)
class Found:
    selected: tuple[Candidate, ...]
    generated: int
    rejected: dict[str, int]
    relaxed: tuple[str, ...]


def _any_of(profiles: DataFrame, names: Sequence[str]) -> Column:
    there = [F.col(c) for c in names if c in profiles.columns]
    return F.coalesce(*there, F.lit(0))


def _demanded(profiles: DataFrame, destination: bool, season: bool) -> Column:
    if season:
        searched = F.col("season_match_count") > 0
        if destination:
            searched = searched & (F.col("destination_match_count") > 0)
        exact = F.col("promotion_condition_search_count") if "promotion_condition_search_count" in profiles.columns else F.lit(None)
        return F.coalesce(exact > 0, searched)
    return _any_of(profiles, ("target_destination_search_count", "destination_match_count")) > 0 if destination else F.lit(True)


def _shows(profiles: DataFrame, choice: Choice) -> Column:
    key, least = choice
    shown = _any_of(profiles, BEHAVIOURS[key][1]) >= least
    return shown & (F.col("booking_complete_count") == 0) if key == UNFINISHED else shown


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class Anchor:
    """Who meets the demand, perhaps with some of it given up."""

    condition: Column
    conditions: int
    season: bool
    properties: bool
    relaxed: tuple[str, ...]
    everyone: int


def anchor(profiles: DataFrame, demand: Demand, minimum: int) -> Anchor | None:
    """The strictest form of the demand that enough users meet: whole, without its properties, or without its season too; None if there is none.

    Properties are given up only if all of them may be, the season only where a
    destination remains.
    """
    keys = tuple(sorted(demand.properties))
    steps: list[tuple[bool, tuple[str, ...], tuple[str, ...]]] = [(demand.season, keys, ())]
    if keys and demand.relaxable.issuperset(keys):
        steps.append((demand.season, (), keys))
        if demand.destination and demand.season:
            steps.append((False, (), (*keys, "season_months")))
    conditions = [_demanded(profiles, demand.destination, season) & _all([demand.properties[k] for k in kept]) for season, kept, _ in steps]
    sizes = profiles.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(conditions))).first()
    for i, (season, kept, given_up) in enumerate(steps):
        if sizes[f"_{i}"] >= minimum:
            return Anchor(conditions[i], int(demand.destination or season) + len(kept), season, bool(kept), given_up, sizes["n"])
    return None


def score(choices: Sequence[Choice], users: int, everyone: int, rates: dict[str, float], desired: Sequence[str], minimum: int) -> float:
    """The score of a candidate: six parts between 0 and 1, less the penalties for many choices and few users."""
    dimensions = [BEHAVIOURS[k][0] for k, _ in choices]
    reach = users / max(everyone, 1)
    aligned = sum(k in desired or d in ALIGNED for (k, _), d in zip(choices, dimensions, strict=True))
    intent = sum(INTENT[d] for d in dimensions) / len(choices) if choices else NO_CHOICE_INTENT
    if any(k == UNFINISHED for k, _ in choices):
        intent = min(1.0, intent + 0.05)
    parts = {
        "promotion_alignment": min(1.0, 0.7 + aligned / max(10.0, len(choices) * 3.0)),
        "behavior_intent": intent,
        "sample_reliability": min(1.0, users / max(minimum * 3.0, 1.0)),
        "expected_booking": min(1.0, sum(w * rates[k] for k, w in BOOKING.items())),
        "audience_reach": min(1.0, math.sqrt(reach)),
        "distinctiveness": max(0.0, 1.0 - reach),
    }
    small = max(0.0, (minimum * 2 - users) / max(minimum * 2, 1)) * SMALL_SAMPLE
    return sum(w * parts[k] for k, w in SCORE.items()) - max(0, len(choices) - 1) * EXTRA_CHOICE - small


def scored(profiles: DataFrame, base: Anchor, level: Sequence[tuple[Choice, ...]], desired: Sequence[str], minimum: int) -> list[Candidate]:
    """All candidates of a level with their users and score, from one pass."""
    if not level:
        return []
    rows = profiles.where(base.condition)
    counts = []
    for i, choices in enumerate(level):
        own = _all([_shows(rows, c) for c in choices])
        counts += [F.count_if(own).alias(f"n{i}"), *(F.count_if(own & (F.col(f"{k}_count") > 0)).alias(f"{k}{i}") for k in BOOKING)]
    got = rows.agg(*counts).first()
    found = []
    for i, choices in enumerate(level):
        users = got[f"n{i}"]
        rates = {k: got[f"{k}{i}"] / users if users else 0.0 for k in BOOKING}
        found.append(Candidate(choices, users, score(choices, users, base.everyone, rates, desired, minimum)))
    return found


def intersections(profiles: DataFrame, base: Anchor, candidates: Sequence[Candidate]) -> dict[tuple[int, int], int]:
    """How many users every two candidates share, by their numbers; pairs that share none are left out.

    Users are counted by the set of candidates they belong to before any pair is made.
    """
    if len(candidates) < 2:
        return {}
    rows = profiles.where(base.condition)
    member = F.filter(F.array(*(F.when(_all([_shows(rows, k) for k in c.choices]), F.lit(i)) for i, c in enumerate(candidates))), lambda x: x.isNotNull())
    sets = rows.groupBy(member.alias("held")).agg(F.count(F.lit(1)).alias("n"))
    pair = F.flatten(F.transform("held", lambda a: F.transform(F.filter("held", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = sets.select("n", F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in found.collect()}


def _extensions(beam: Sequence[tuple[Choice, ...]], registry: Sequence[str], seen: set[tuple[Choice, ...]], room: int, rejected: Counter) -> list[tuple[Choice, ...]]:
    """New candidates with one more behaviour than those of the beam, in the registry's order; no more than there is room for."""
    place = {k: i for i, k in enumerate(BEHAVIOURS)}
    level: list[tuple[Choice, ...]] = []
    for choices in beam:
        used = {k for k, _ in choices}
        for key in registry:
            if len(level) == room:
                return level
            if key in used:
                rejected["duplicate_predicate"] += 1
                continue
            if any(key in pair and used & (pair - {key}) for pair in EXCLUSIVE):
                rejected["conflict"] += 1
                continue
            for least in BEHAVIOURS[key][2]:
                new = tuple(sorted((*choices, (key, least)), key=lambda c: (place[c[0]], c[1])))
                if new not in seen and len(level) < room:
                    seen.add(new)
                    level.append(new)
    return level


def search(profiles: DataFrame, demand: Demand, minimum: int, desired: Sequence[str] = (), policy: Policy | None = None) -> Found:
    """The best audiences for a promotion, none too like one chosen before, with how many were rejected for what.

    A candidate is rejected if it has too many conditions or too few users, if it
    is everyone, or if its members are those of one that scores no less.
    """
    policy = policy or Policy()
    base = anchor(profiles, demand, minimum)
    if base is None:
        return Found((), 0, {"minimum_sample": 1}, ())
    rejected: Counter = Counter()
    registry = [k for k in BEHAVIOURS if k != "destination_repeat_search" or demand.destination]
    seen: set[tuple[Choice, ...]] = set()
    kept: list[Candidate] = []
    if base.properties:
        kept = [c for c in scored(profiles, base, [()], desired, minimum) if minimum <= c.users != base.everyone]
    beam: list[tuple[Choice, ...]] = [()]
    generated = 0
    shared: dict[tuple[tuple[Choice, ...], tuple[Choice, ...]], int] = {}
    for _ in range(policy.depth):
        level = _extensions(beam, registry, seen, policy.generated - generated, rejected)
        generated += len(level)
        fit = [c for c in level if base.conditions + sum(1 + (k == UNFINISHED) for k, _ in c) <= MOST_CONDITIONS]
        rejected["unusable"] += len(level) - len(fit)
        new = []
        for c in scored(profiles, base, fit, desired, minimum):
            if c.users < minimum:
                rejected["minimum_sample"] += 1
            elif c.users == base.everyone:
                rejected["same_as_all_users"] += 1
            else:
                new.append(c)
        both = [*kept, *new]
        for (a, b), n in intersections(profiles, base, both).items():
            shared[both[a].choices, both[b].choices] = shared[both[b].choices, both[a].choices] = n
        for c in new:
            twin = next((k for k in kept if k.users == c.users == shared.get((k.choices, c.choices), 0)), None)
            if twin is not None:
                rejected["duplicate_members"] += 1
                if c.score <= twin.score:
                    continue
                kept.remove(twin)
            kept.append(c)
        beam = [c.choices for c in sorted(set(new) & set(kept), key=lambda c: c.rank)[: policy.width]]
        if not beam or generated >= policy.generated:
            break
    selected: list[Candidate] = []
    for c in sorted(kept, key=lambda c: c.rank):
        meets = [shared.get((c.choices, s.choices), 0) for s in selected]
        like = max((m / (c.users + s.users - m) if m else 0.0 for m, s in zip(meets, selected, strict=True)), default=0.0)
        if like >= policy.similarity:
            rejected["candidate_overlap"] += 1
            continue
        selected.append(Candidate(c.choices, c.users, c.score - like * OVERLAP))
        if len(selected) == policy.final:
            break
    return Found(tuple(selected), generated, {k: n for k, n in sorted(rejected.items()) if n}, base.relaxed)
