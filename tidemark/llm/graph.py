"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize, scratch


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node that can be reached) for every node of ``edges`` (a, b).

    Every round each node follows its smallest neighbour, and that one's; then
    the edges are drawn between the nodes that were reached, without loops and
    repeats.  So what is left to do shrinks from round to round, a star goes at
    once, and the rounds grow with the logarithm of the longest path in practice.
    Each round is written to the shared folder; the driver sees one count a round.
    """
    with scratch(edges.sparkSession):
        known = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
        known = materialize(known, "edges")
        nodes = known.select(F.col("a").alias("node")).unionAll(known.select(F.col("b").alias("node"))).distinct()
        left, steps = known.where("a <> b"), []
        while left.limit(1).count():
            both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
            first = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "first")
            up = materialize(first.join(first.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("up")), "up")
            steps.append(up)
            to = lambda side: up.select(F.col("node").alias(side), F.col("up").alias(f"up_{side}"))  # noqa: B023, E731
            drawn = left.join(to("a"), "a").join(to("b"), "b").where("up_a <> up_b")
            left = materialize(drawn.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        found = nodes.withColumn("up", F.col("node"))
        if steps:
            tops = steps.pop()
            while steps:
                above = tops.select(F.col("node").alias("up"), F.col("up").alias("top"))
                tops = steps.pop().join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"))
            found = nodes.join(tops, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
        return materialize(found.withColumnRenamed("up", "component"), "components", outer=True)
