"""Structured Streaming forms of the event operators: an extension, the batch forms are the reference's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value by type in tumbling windows; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n_events", "total")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first of events that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert_batches(events: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """A query that keeps the latest row of each key in a Parquet folder, written anew for each micro-batch."""
    from ..operators.ledger import latest, upsert_latest_wins

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, order)
        if batch_id > 0:
            new = upsert_latest_wins(spark.read.parquet(f"{path}/batch={batch_id - 1}"), new, keys, order)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
