"""External adapters and driver-side decisions."""

from __future__ import annotations

import zipfile
from datetime import datetime

import pytest

from tidemark.operators import policies
from tidemark.sources import external


def test_trips_hide_the_last_city(spark, tmp_path):
    (tmp_path / "train.csv").write_text("utrip_id,city_id,checkin,checkout\na,1,2020-01-01,2020-01-02\nb,9,2020-01-01,2020-01-02\na,3,2020-01-05,2020-01-06\na,2,2020-01-02,2020-01-05\n")
    got = external.trips(spark, str(tmp_path / "train.csv"), external.Sampling()).collect()
    assert [(r["trip_id"], r["cities"], r["outcome"]) for r in got] == [("a", ["1", "2"], "3")]
    (tmp_path / "truth.csv").write_text("utrip_id,city_id\na,7\n")
    got = external.trips(spark, str(tmp_path / "train.csv"), external.Sampling(), str(tmp_path / "truth.csv"))
    assert [(r["cities"], r["outcome"]) for r in got.collect()] == [(["1", "2", "3"], "7")]
    assert [tuple(r) for r in external.top_cities(got, 1, 2).collect()] == [("1", 1), ("2", 1)]
    (tmp_path / "bad.csv").write_text("utrip_id,city_id\na,7\n")
    with pytest.raises(ValueError):
        external.trips(spark, str(tmp_path / "bad.csv"), external.Sampling())


def test_equal_stays_keep_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("utrip_id,city_id,checkin,checkout\na,9,2020-01-01,2020-01-02\na,3,2020-01-01,2020-01-02\na,0,2020-01-01,2020-01-02\na,5,2020-01-01,2020-01-02\n")
    (tmp_path / "truth.csv").write_text("utrip_id,city_id\na,7\n")
    path = str(tmp_path / "t.csv")
    assert external.trips(spark, path, external.Sampling()).first()["cities"] == ["9", "3", "0"]
    assert external.trips(spark, path, external.Sampling(), str(tmp_path / "truth.csv")).first()["cities"] == ["9", "3", "5"]


def test_fingerprints_do_not_depend_on_order():
    a, b = {"segment_id": "s1", "audience_snapshot_id": "x"}, {"segment_id": "s2", "audience_snapshot_id": "w"}
    assert policies.input_fingerprint([a, b]) == policies.input_fingerprint([b, a]) != policies.input_fingerprint([a])
    assert policies.request_fingerprint("r", "d", None) != policies.request_fingerprint("r", "d", 7)
    made = policies.execution_id("r", "f")
    assert made.startswith("assign_exec_") and len(made) == 60


def test_sessions_leave_outcomes_out(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("train_users_2.csv", "id,country_destination,age,gender,affiliate_channel\nu1,FR,25,MALE,direct\nu2,NDF,x,FEMALE,seo\nu3,US,40,MALE,seo\n")
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("sessions.csv", "user_id,action,action_type,action_detail\nu1,search,click,view_search_results\nu1,requested,booking_request,x\nu1,show,view,p3\nu2,other,data,\n")
    got = {r["user_id"]: r for r in external.sessions(spark, str(tmp_path / "u.zip"), str(tmp_path / "s.zip"), external.Sampling()).collect()}
    assert set(got) == {"u1", "u2"} and got["u1"]["booked"] and not got["u2"]["booked"]
    u = got["u1"]
    assert (u["event_count"], u["hotel_search_count"], u["hotel_click_count"], u["hotel_detail_view_count"], u["age_group"]) == (2, 1, 1, 2, "20s")


def test_commerce_windows_are_half_open(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "client_id long, timestamp string, sku long")
    d = str(tmp_path)
    rows((1, "2024-01-02 00:00:00", None), (2, "2024-01-01 00:00:00", None)).drop("sku").write.parquet(f"{d}/search_query.parquet")
    rows((1, "2024-01-03 00:00:00", 5), (1, "bad", 5)).write.parquet(f"{d}/add_to_cart.parquet")
    rows((3, "2023-01-03 00:00:00", 5)).write.parquet(f"{d}/remove_from_cart.parquet")
    rows((1, "2024-01-10 00:00:00", 6), (2, "2024-01-20 00:00:00", 6)).write.parquet(f"{d}/product_buy.parquet")
    spark.createDataFrame([(5, 50), (6, 60)], "sku long, category long").write.parquet(f"{d}/product_properties.parquet")
    got = {r["client_id"]: r for r in external.commerce(spark, d, external.Sampling(), "2024-01-01", "2024-01-10", "2024-01-20").collect()}
    assert set(got) == {1, 2} and got[1]["bought"] and not got[2]["bought"]
    assert (got[1]["search_count"], got[1]["add_count"], got[1]["categories"]) == (1, 1, [50])


def test_gates_and_ids():
    assert policies.canonical_hash({"b": 1, "a": [2]}) == policies.canonical_hash({"a": [2], "b": 1})
    assert policies.stable_id("gen", "p", datetime(2024, 1, 1).isoformat()) == policies.stable_id("gen", "p", datetime(2024, 1, 1).isoformat())
    enough = dict.fromkeys(policies.VALIDATION_MINIMA, 5000)
    assert policies.validation_gate(enough, {"qini": 0.1, "auuc": 1.0, "auuc_baseline": 0.5}) == []
    assert policies.validation_gate({}, {"qini": float("nan")}) == [*policies.VALIDATION_MINIMA, "qini_above_zero", "auuc_above_baseline"]
    assert policies.select_share(10, 0.8, 5) == policies.Selection(8, 0.8, None)
    assert policies.select_share(5, 0.8, 5).selected == 5 and policies.select_share(0, 0.8, 5).reason == "empty_candidate"
    assert policies.choose_ratio({0.2: 0.1, 0.8: 0.05}, {0.2: 0.3, 0.8: 0.87}, 0.8) == 0.8 and policies.choose_ratio({}, {}, 0.8) == 1.0
