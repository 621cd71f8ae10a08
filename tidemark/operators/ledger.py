"""Writes as set operations: upserts, inserts and state transitions over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``; one aggregation with map-side combine, no window."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert_latest_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Both tables with one row per key: a new row replaces an old one only if it isn't older by ``order``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [*order, "_new"]).drop("_new")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The new rows that are inserted: keys that aren't there, the first by ``ordinal`` of each."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))
    return first.join(old.select(*keys).distinct(), list(keys), "left_anti")


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """New rows over old ones; of the ``keep`` columns an old value stays where it isn't null."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), list(keys), "full")
    return joined.select(*keys, *((F.coalesce(f"o.{c}", f"n.{c}") if c in keep else F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in rest))


def transition(ledger: DataFrame, keys: Sequence[str], requests: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """New ledger rows (keys, state, revision) for the requests (keys, state) that the current state allows."""
    now = latest(ledger, keys, ["revision"])
    joined = now.alias("l").join(requests.withColumnRenamed("state", "wanted").alias("r"), list(keys))
    ok: Column = F.lit(False)
    for target, sources in allowed.items():
        ok = ok | ((F.col("wanted") == target) & F.col("l.state").isin(*sources))
    return joined.where(ok).select(*keys, F.col("wanted").alias("state"), (F.col("l.revision") + 1).alias("revision"))


def append_arrays(batches: DataFrame, arrays: Sequence[str], position: str = "position") -> DataFrame:
    """One row for each place of the parallel arrays of a batch, with the batch's other columns and the place (from 1).

    A batch whose arrays are empty or null gives none; arrays of unequal lengths are filled with nulls.
    """
    rest = [c for c in batches.columns if c not in arrays]
    zipped = F.posexplode(F.arrays_zip(*(F.coalesce(F.col(a), F.array()).alias(a) for a in arrays)))
    return batches.select(*rest, zipped.alias("_at", "_row")).select(*rest, (F.col("_at") + 1).cast("long").alias(position), *(F.col(f"_row.{a}").alias(a) for a in arrays))
