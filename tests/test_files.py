"""File sources, sinks, snapshots and streams."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import types as T

from tidemark.sources import files
from tidemark.streaming import events as streams


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert files.read_csv(spark, str(tmp_path / "a.csv"), schema).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType())]))


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "users.zip", "w") as z:
        z.writestr("users.csv", "﻿id,age\n1,30\n2,\n".encode("utf-8"))
    got = files.read_zipped_csv(spark, str(tmp_path / "users.zip"), "users.csv", ["id", "age"]).collect()
    assert [tuple(r) for r in got] == [("1", "30"), ("2", "")]
    with pytest.raises(Exception, match="lacks"):
        files.read_zipped_csv(spark, str(tmp_path / "users.zip"), "users.csv", ["id", "gender"]).collect()


def test_load_once_and_reports(spark, tmp_path):
    rows, path = spark.range(3), str(tmp_path / "t")
    assert files.load_once(spark, rows, path) and not files.load_once(spark, spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert files.load_once(spark, spark.range(9), path, replace=True) and spark.read.parquet(path).count() == 9
    files.write_reports(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 3
    assert files.markdown(rows.orderBy("id")).splitlines()[2] == "| 0 |"


def test_generations_swap_only_when_complete(spark, tmp_path):
    g = files.Generations(spark, str(tmp_path / "g"))
    assert g.active() is None
    g.activate("one", g.write("one", spark.range(3)))
    g.write("two", spark.range(5))
    with pytest.raises(ValueError):
        g.activate("two", 6)
    assert g.active() == "one" and g.read().count() == 3
    g.activate("two", 5)
    assert g.active() == "two" and g.read().count() == 5


def test_projection_reaches_the_scan(spark, sf_dir):
    df = files.projected(spark, f"{sf_dir}/events.parquet", ["event_id"], "ts", "2024-01-05", "2024-01-06")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp" in plan


def test_windowed_stream_equals_batch(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value", "props").write.parquet(source)
    q = streams.windowed_counts(streams.read_events(spark, source), "1 day").writeStream.format("memory").queryName("td_windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    batch = streams.windowed_counts(spark.read.parquet(source), "1 day")
    key = lambda d: sorted((r["start"], r["event_type"], r["n_events"]) for r in d.collect())
    assert key(spark.table("td_windows")) == key(batch)


def test_streamed_upserts_keep_the_latest(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k long, n long, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for extra in ([], [(1, 2, "c"), (2, 4, "d")]):
        if extra:
            spark.createDataFrame(extra, schema).write.mode("append").parquet(source)
        q = streams.upsert_batches(stream, out, str(tmp_path / "c"), ["k"], ["n"]).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/batch=1").select("k", "n", "v").collect()) == [(1, 2, "c"), (2, 5, "b")]
