"""Ranks, samples, cuts and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import first_eight
from ..sources.scratch import shared_dir


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as it is now: a checkpoint, so that a value that depends on the run, as a partition number, is the same wherever it is read."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _parted(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in range partitions with their number in ``_part``; the number of partitions is fixed, so none are merged."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pinned(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def global_rank(rows: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1, 2, 3 ... over all rows without a single-task window: rows are range-partitioned, ranked where they are, and shifted by the sizes before."""
    parted = _parted(rows, order)
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def group_rank(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with the rank in their group in ``_rank`` and the group's size in ``_n``, without a task for each group.

    Range partitions by group and order cut large groups; a group's rows in one
    partition are ranked there and shifted by its rows in the partitions before.
    The windows over sizes see a row for each group and partition that meet.
    """
    parted = _parted(rows.withColumn("_group", F.struct(*group)), [F.col("_group"), *order])
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order)))
    sizes = parted.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_size").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_group", "_part", before.alias("_before"), F.sum("_size").over(w).alias("_n"))
    ranked = local.join(offsets, ["_group", "_part"])
    return ranked.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_local") + F.col("_before")).alias("_rank"), "_n")


def lower_median(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The group and the lower of the two middle values, nulls left out, without a task for each group.

    Equal values are counted first; running counts go over range partitions and
    are shifted as in ``group_rank``.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    parted = _parted(counts.withColumn("_group", F.struct(*group)), [F.col("_group"), F.col(value)])
    local = parted.withColumn("_local", F.sum("_n").over(Window.partitionBy("_part", "_group").orderBy(value)))
    sizes = parted.groupBy("_group", "_part").agg(F.sum("_n").alias("_size"))
    w = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_size").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_group", "_part", before.alias("_before"), F.sum("_size").over(w).alias("_all"))
    upper = local.join(offsets, ["_group", "_part"]).where("2 * (_local + _before) >= _all")
    return upper.groupBy(*group).agg(F.min(value).alias("median"))


def salted_order(key: Column, salt: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(salt)))


def salted_sample(rows: DataFrame, key: str, salt: str, n: int, among: int | None = None) -> DataFrame:
    """A deterministic sample: the n smallest salted hashes.

    Where the number of rows is known (``among``), hashes that are too large for
    about twice the sample are left out before any task keeps its n smallest; the
    sample is the same, but for a chance of less than 1e-15.
    """
    if among and among > 4 * n + 400:
        bound = int((2 * n + 100) / among * (1 << 52))
        rows = rows.where(F.conv(F.substring(salted_order(F.col(key), salt), 1, 13), 16, 10).cast("long") < bound)
    return rows.orderBy(salted_order(F.col(key), salt), key).limit(n)


def stable_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n distinct keys of smallest SHA-256; the same in every engine and for any order of rows."""
    return rows.select(key).distinct().orderBy(first_eight(F.col(key).cast("string")), key).limit(n)


def keyset_page(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def strength_cut(rows: DataFrame, group: Sequence[str], strength: Column, tie: str, ratio: float, minimum: int) -> DataFrame:
    """The strongest ``ceil(n * ratio)`` rows of each group; all of them where those would be fewer than ``minimum``."""
    ranked = group_rank(rows, group, [strength.desc(), F.col(tie)])
    cut = F.ceil(F.col("_n") * ratio)
    return ranked.where((F.col("_rank") <= cut) | (cut < minimum)).drop("_rank", "_n")


def jaccard(members: DataFrame, group: str, member: str) -> DataFrame:
    """Jaccard similarity of the member sets of every two groups that share a member: left, right, similarity."""
    rows = members.select(group, member).distinct()
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col(f"a.{member}") == F.col(f"b.{member}")) & (F.col(f"a.{group}") < F.col(f"b.{group}"))).groupBy(F.col(f"a.{group}").alias("left"), F.col(f"b.{group}").alias("right")).agg(F.count(F.lit(1)).alias("shared"))
    sized = both.join(sizes.select(F.col(group).alias("left"), F.col("n").alias("n_left")), "left").join(sizes.select(F.col(group).alias("right"), F.col("n").alias("n_right")), "right")
    return sized.select("left", "right", (F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared"))).alias("similarity"))


def overlap_counts(members: DataFrame, positives: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: its members, and how many of them are among the positives."""
    known = positives.select(member).distinct().withColumn("_positive", F.lit(True))
    return members.join(known, member, "left").groupBy(group).agg(F.count(F.lit(1)).alias("members"), F.count("_positive").alias("positives"))
