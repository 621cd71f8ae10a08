"""Query vectors, scratch relations, generations that were broken off, array batches."""

from __future__ import annotations

import math

import pytest

from tidemark.operators import ledger, query_vectors
from tidemark.sources import files, scratch


def norm(v):
    return math.sqrt(sum(x * x for x in v))


def block(v, name):
    lo, hi = query_vectors.BLOCKS[name]
    return v[lo : hi + 1]


def test_candidate_query_has_the_weights_of_its_blocks():
    v = query_vectors.candidate_query("intent_matched", ["제주", "Seoul"], ["Winter", "monsoon"])
    assert len(v) == 64 and math.isclose(norm(v), 1.0)
    sizes = {b: norm(block(v, b)) for b in query_vectors.BLOCKS}
    assert math.isclose(sizes["funnel"], sizes["destination"]) and math.isclose(sizes["timing"] / sizes["funnel"], 0.15 / 0.35)
    assert sizes["benefit"] == sizes["promotion_response"] == 0
    bare = query_vectors.candidate_query("intent_matched")
    assert norm(block(bare, "destination")) == norm(block(bare, "timing")) == 0 and math.isclose(norm(bare), 1.0)


def test_benefits_asked_for_replace_those_of_the_type():
    v = query_vectors.candidate_query("benefit_value_seeker", benefits=["breakfast_included", "unknown"])
    at = query_vectors.SIGNALS
    assert v[at["breakfast_interest"]] > 0 and v[at["benefit_breadth"]] > 0
    assert v[at["deal_interest_intensity"]] == v[at["price_interest_intensity"]] == v[at["free_cancellation_interest"]] == 0
    assert query_vectors.candidate_query("funnel_recovery", benefits=["discount"]) == query_vectors.candidate_query("funnel_recovery")


def test_segment_query_weighs_its_active_blocks():
    v = query_vectors.segment_query(["hotel_search_intensity", "has_hotel_interest"], ["jeju"], [12, 1, 7])
    sizes = {b: norm(block(v, b)) for b in query_vectors.BLOCKS}
    assert all(math.isclose(sizes[b], 0.5) for b in ("funnel", "destination", "timing", "derived"))
    assert v[query_vectors.SIGNALS["winter_checkin_share"]] == v[query_vectors.SIGNALS["summer_checkin_share"]] > 0
    kind = query_vectors.segment_query(["hotel_search_intensity"], ["jeju"], kind="funnel_recovery")
    assert math.isclose(norm(block(kind, "funnel")) / norm(block(kind, "destination")), 0.55 / 0.25)
    for wrong in (lambda: query_vectors.segment_query(["nothing"]), lambda: query_vectors.segment_query([]), lambda: query_vectors.candidate_query("nobody")):
        with pytest.raises(ValueError):
            wrong()


def test_predicates_of_a_candidate():
    assert query_vectors.candidate_predicates("intent_matched", ["jeju"], ["winter"]) == ["hotel_product_interest", "recent_destination_search", "season_match"]
    assert query_vectors.candidate_predicates("promotion_responsive", ["jeju"], ["winter"]) == ["promotion_response"]


def test_relation_lives_for_its_block(spark):
    with scratch.relation(spark, "td_block", spark.range(5)) as n:
        assert n == 5 and spark.sql("SELECT sum(id) FROM td_block").first()[0] == 10
    assert not spark.catalog.tableExists("td_block")
    with pytest.raises(RuntimeError):
        with scratch.relation(spark, "td_block", spark.range(0)) as n:
            assert n == 0
            raise RuntimeError
    assert not spark.catalog.tableExists("td_block")


def test_generation_resumes_without_repeats(spark, tmp_path):
    g = files.Generations(spark, str(tmp_path / "g"))
    assert g.resume("a", spark.range(2), ["id"]) == 2 and g.resume("a", spark.range(6), ["id"]) == 6 and g.resume("a", spark.range(6), ["id"]) == 6
    g.activate("a", 6)
    with pytest.raises(ValueError):
        g.resume("a", spark.range(9), ["id"])


def test_arrays_of_a_batch_become_rows(spark):
    rows = spark.createDataFrame([(1, [5, 6], ["a", "b"]), (2, [], []), (3, None, ["x"])], "k long, n array<long>, v array<string>")
    got = sorted(tuple(r) for r in ledger.append_arrays(rows, ["n", "v"]).collect())
    assert got == [(1, 1, 5, "a"), (1, 2, 6, "b"), (3, 1, None, "x")]
