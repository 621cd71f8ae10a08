"""The search policy and its index against a search of everything."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import audience_search as search

DIM, N = 8, 2_000


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, DIM))
    v = centres[rng.integers(0, 12, N)] + 0.15 * rng.normal(size=(N, DIM))
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "user_id long, embedding array<double>")
    index = search.CellIndex.build(rows, str(tmp_path_factory.mktemp("index") / "cells"), "user_id", cells=16, sample=500)
    q = centres[3]
    size = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
    score = np.where(size > 0, (v @ q) / np.where(size > 0, size, 1), -1.0)
    return index, q.tolist(), score


def keys(df):
    return {r["user_id"] for r in df.collect()}


SMALL = {"exact": 10, "transition": 20, "least": 300, "least_audit": 1500}


def test_every_vector_is_indexed(corpus):
    index, q, _ = corpus
    assert index.size == N and keys(index.rows) == set(range(N))
    assert sum(index.sizes[c] for c in index.cells(q, 300)) >= 300 and set(index.cells(q, N)) == set(index.sizes)


def test_small_corpora_are_searched_whole(corpus):
    index, q, score = corpus
    found = search.search(index, q, 0.9)
    assert found.method == "exact" and found.audit is None and keys(found.members) == set(np.flatnonzero(score >= 0.9).tolist())


def test_index_finds_nine_tenths_and_reads_only_its_cells(corpus):
    index, q, score = corpus
    found = search.search(index, q, 0.9, policy=search.Policy(**SMALL, target=0.7))
    wanted = set(np.flatnonzero(score >= 0.9).tolist())
    assert found.method == "index" and found.audit.accepted and found.requested < N / 2
    assert len(keys(found.members) & wanted) >= 0.9 * len(wanted) and keys(found.members) <= wanted
    plan = found.members._jdf.queryExecution().executedPlan().toString()
    assert "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_transition_is_exact_and_audits_the_index(corpus):
    index, q, score = corpus
    few = index.rows.where("user_id % 2 = 0").select("user_id")
    found = search.search(index, q, 0.9, matching=few, policy=search.Policy(exact=10, transition=N, least=300))
    wanted = {i for i in np.flatnonzero(score >= 0.9).tolist() if i % 2 == 0}
    assert found.method == "transition" and keys(found.members) == wanted
    assert found.audit.retrieved + found.audit.missed == len(wanted) and found.audit.estimated_recall >= 0.9


def test_a_low_threshold_falls_back_to_the_whole(corpus):
    index, q, score = corpus
    found = search.search(index, q, -0.5, policy=search.Policy(**SMALL))
    assert found.method == "exact_fallback" and keys(found.members) == set(np.flatnonzero(score >= -0.5).tolist())


def test_sampled_audit():
    good = search.sampled_audit(1000, 10_000, 0, 5_000)
    upper = search.Z**2 / 10_000 / (1 + search.Z**2 / 10_000)
    assert good.estimated_recall == 1.0 and math.isclose(good.lower_bound, 1000 / (1000 + upper * 5_000)) and good.accepted
    assert not search.sampled_audit(1000, 0, 0, 5_000).accepted and search.sampled_audit(0, 0, 0, 0).lower_bound == 1.0


def test_empty_corpus(spark, tmp_path):
    rows = spark.createDataFrame([], "user_id long, embedding array<double>")
    index = search.CellIndex.build(rows, str(tmp_path / "none"), "user_id")
    assert index.size == 0 and search.search(index, [1.0], 0.5).members.count() == 0


def test_sample_is_the_same_with_a_known_size(spark):
    from tidemark.operators.ranking import salted_sample

    rows = spark.range(5_000)
    assert {r[0] for r in salted_sample(rows, "id", "x", 20, 5_000).collect()} == {r[0] for r in salted_sample(rows, "id", "x", 20).collect()}
