"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import dropped, written


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component): each node of the (a, b) edges with the smallest node that it reaches.

    Alternating large and small stars: every round ties a node's larger neighbours, then its
    smaller ones, to its smallest neighbour, until the edges are stars. A round is two
    aggregations with map-side minima and two joins whose large keys Spark may split; its edges
    are written to the shared folder, so that neither plans nor lost executors pile up.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", "low")).distinct()
        after = written(small)
        dropped(now)
        now = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(now.select("b", "b").distinct())
