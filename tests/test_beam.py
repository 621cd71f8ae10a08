"""The beam search against a search over the users themselves."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import beam

COUNTS = ["destination_match", "season_match", "promotion_condition_search", "hotel_detail_view", "booking_start", "booking_complete", "price_event", "deal_event", "free_cancellation", "breakfast_included", "promotion_click", "campaign_landing"]


def users(n=80):
    return [{"user_id": i, "age": i % 3, **{f"{c}_count": (i * (2 * k + 3) // (k + 2) + k) % (2 + k % 3) for k, c in enumerate(COUNTS)}} for i in range(n)]


def shows(u, choice):
    key, least = choice
    name = [c for c in beam.BEHAVIOURS[key][1] if c in u][-1]
    return u[name] >= least and (key != beam.UNFINISHED or u["booking_complete_count"] == 0)


def by_force(rows, minimum, choices_of):
    """Members and score of every candidate, from lists of users."""
    inside = [u for u in rows if u["promotion_condition_search_count"] > 0]
    found = {}
    for choices in choices_of:
        own = [u for u in inside if all(shows(u, c) for c in choices)]
        rates = {k: sum(u[f"{k}_count"] > 0 for u in own) / len(own) if own else 0.0 for k in beam.BOOKING}
        found[choices] = frozenset(u["user_id"] for u in own), beam.score(choices, len(own), len(rows), rates, (), minimum)
    return found


def singles():
    return [((k, n),) for k, (_, _, options) in beam.BEHAVIOURS.items() for n in options]


def test_search_equals_brute_force(spark):
    rows = users()
    df, minimum = spark.createDataFrame(rows), 5
    demand = beam.Demand(destination=True, season=True)
    every = by_force(rows, minimum, singles())
    fit = [c for c in singles() if minimum <= len(every[c][0]) != len(rows)]
    best = {}
    for c in fit:
        members, own = every[c]
        if members not in best or own > every[best[members]][1]:
            best[members] = c
    order = sorted(best.values(), key=lambda c: (-every[c][1], -len(every[c][0]), c))
    chosen = []
    for c in order:
        like = max((len(every[c][0] & every[s][0]) / len(every[c][0] | every[s][0]) for s, _ in chosen), default=0.0)
        if like < 0.85 and len(chosen) < 3:
            chosen.append((c, every[c][1] - 0.12 * like))
    found = beam.search(df, demand, minimum)
    assert [(c.choices, round(c.score, 9)) for c in found.selected] == [(c, round(s, 9)) for c, s in chosen] and len(chosen) == 3
    assert found.generated == len(singles()) and found.rejected.get("duplicate_members", 0) == len(fit) - len(best) and found.relaxed == ()


def test_second_level_extends_the_beam_without_conflicts(spark):
    df = spark.createDataFrame(users())
    found = beam.search(df, beam.Demand(destination=True), 3, policy=beam.Policy(depth=2, final=8, similarity=1.1))
    assert found.generated == 50 and found.rejected["conflict"] + found.rejected["duplicate_predicate"] > 0
    assert all(not pair <= {k for k, _ in c.choices} for c in found.selected for pair in beam.EXCLUSIVE)
    counts = [len({k for k, _ in c.choices}) == len(c.choices) for c in found.selected]
    assert all(counts) and all(a.rank[0] <= b.rank[0] + 0.12 for a, b in combinations(found.selected, 2))


def test_demand_is_relaxed_in_order(spark):
    rows = users()
    df = spark.createDataFrame(rows)
    season = sum(u["promotion_condition_search_count"] > 0 for u in rows)
    here = sum(u["destination_match_count"] > 0 for u in rows)
    demand = beam.Demand(destination=True, season=True, properties={"age_group": F.col("age") == 0})
    assert here != season
    assert beam.anchor(df, demand, 1).relaxed == ()
    assert beam.anchor(df, demand, season).relaxed == ("age_group",)
    if here > season:
        assert beam.anchor(df, demand, here).relaxed == ("age_group", "season_months")
    assert beam.anchor(df, demand, len(rows) + 1) is None
    assert beam.search(df, demand, len(rows) + 1) == beam.Found((), 0, {"minimum_sample": 1}, ())
    fixed = beam.Demand(destination=True, season=True, properties={"tier": F.col("age") == 0})
    assert beam.anchor(df, fixed, season) is None


def test_empty_profiles_have_no_audience(spark):
    df = spark.createDataFrame(users()).limit(0)
    assert beam.search(df, beam.Demand(), 1).selected == ()
