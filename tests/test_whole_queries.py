"""Queries that do the whole job, against SQL without any cut or brute force."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import numpy as np
from conftest import table
from pyspark.sql import functions as F

from tidemark.plans import catalog


def check_on(spark, folder, name, source):
    """Asserts that a query and its SQL agree on a table of its own; the SQL runs on one thread, so that it adds in the order of the files."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"SET timezone = 'UTC'; CREATE VIEW {source} AS SELECT * FROM read_parquet('{folder}/{source}.parquet/*.parquet')")
    df, found = catalog.QUERIES[name](spark, str(folder)), con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.collect(), df.columns) == table(found.fetchall(), names)


def test_range_join_takes_every_line_and_part(same):
    same(catalog.QUERIES["binned_range_join"], "SELECT l_orderkey, count(*) AS pairs FROM lineitem JOIN part ON p_partkey % 5 = l_linenumber AND l_quantity >= p_size AND l_quantity < p_size + 4 GROUP BY l_orderkey")


def kmeans_by_force(ids, vectors, k, rounds):
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v = unit(vectors)
    centres = [v[np.argmin(ids)]]
    while len(centres) < k:
        near = (v @ np.array(centres).T).max(1)
        centres.append(v[min(range(len(ids)), key=lambda i: (near[i], ids[i]))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        for c in set(own.tolist()):
            centres[c] = unit(v[own == c].mean(0))
    return dict(zip(ids, (v @ centres.T).argmax(1).tolist(), strict=True))


def test_kmeans_runs_the_eight_rounds_of_the_reference(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    found = {r["vec_id"]: r["cluster"] for r in catalog.QUERIES["spherical_kmeans"](spark, sf_dir).collect()}
    assert found == kmeans_by_force(ids, vectors, 4, 8) != kmeans_by_force(ids, vectors, 4, 2)


def test_case_order_returns_every_order_in_order(spark, sf_dir, duck):
    sql = "SELECT o_orderkey, o_orderpriority, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey"
    found = [tuple(r) for r in catalog.QUERIES["case_order"](spark, sf_dir).collect()]
    assert found == duck.execute(sql).fetchall() and len({r[1] for r in found}) > 2


def test_holdout_by_hmac_where_the_quota_is_an_exact_half_and_segments_are_null(spark, tmp_path):
    rows = [(f"s{n}", n) for n in (5, 45, 85, 165)] + [(None, 12)]
    keys = iter(range(1000))
    spark.createDataFrame([(next(keys), s) for s, n in rows for _ in range(n)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    check_on(spark, tmp_path, "holdout_hmac", "customer")


def test_first_vectors_add_prices_in_order_and_round_as_their_sql(spark, tmp_path):
    """Means on the half of the sixth decimal over four files, and a share of 41 / 640, whose product with 10^6 lies below the half."""
    rng = np.random.default_rng(7)
    at = datetime(2024, 1, 10)
    for part in range(4):
        ids = range(part * 2000 + 1, part * 2000 + 2001)
        rows = [(i, at + timedelta(seconds=i), int(i % 250), "view", float(rng.integers(20000, 900000)) / 4000, '{"k": 10}') for i in ids if i % 50]
        if part == 3:
            ids = [i for i in range(10_000, 10_700) if i % 50][:640]
            rows += [(i, at, 999, "signup" if n < 41 else "purchase", 1.0, '{"k": 3}') for n, i in enumerate(ids)]
        folder = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1)
        folder.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/parts/{part}")
        (written,) = (tmp_path / "parts" / str(part)).glob("*.parquet")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        written.rename(tmp_path / "events.parquet" / f"{part}.parquet")
    check_on(spark, tmp_path, "behavior_vector_v1", "events")
