"""Joins of events to a window around another event of the same user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_before(anchors: DataFrame, events: DataFrame, key: str, anchor_at: str, event_at: str, days: int, how: str = "left") -> DataFrame:
    """Events in [anchor - days, anchor) of the same key; an equi join on the key with the range as residual."""
    at, e = F.col(f"a.{anchor_at}"), F.col(f"e.{event_at}")
    inside = (e < at) & (e >= at - F.make_dt_interval(days=F.lit(days)))
    return anchors.alias("a").join(events.alias("e"), (F.col(f"a.{key}") == F.col(f"e.{key}")) & inside, how)


def until(anchors: DataFrame, events: DataFrame, key: str, anchor_at: str, event_at: str, cutoff: Column, how: str = "left") -> DataFrame:
    """Events in [anchor, cutoff] of the same key."""
    e = F.col(f"e.{event_at}")
    return anchors.alias("a").join(events.alias("e"), (F.col(f"a.{key}") == F.col(f"e.{key}")) & (e >= F.col(f"a.{anchor_at}")) & (e <= cutoff), how)


def binned_range_join(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Numeric points inside [start, end) of ranges of the same key, by bins of ``width``: no task sees all of a key."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width)).alias("p")
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(start) / width))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), last))).alias("r")
    same = (F.col(f"p.{key}") == F.col(f"r.{key}")) & (F.col("p._bin") == F.col("r._bin"))
    return p.join(r, same & (F.col(f"p.{at}") >= F.col(f"r.{start}")) & (F.col(f"p.{at}") < F.col(f"r.{end}")))
