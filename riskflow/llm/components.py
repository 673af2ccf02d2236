"""Connected components of an edge table, by repeated star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.session import freeze


def _nearest(directed: DataFrame) -> DataFrame:
    """Each node u with the smallest of itself and its neighbours v."""
    return directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of an edge; duplicates and loops do no harm.

    One round ties each node's larger neighbours to its smallest (large star), then its smaller ones (small star);
    a path shortens by a constant factor a round. A hub meets its edges in joins whose other side has one row a node,
    which adaptive execution splits. Edges are written to the shared checkpoint folder after each round, so a lost
    executor costs one round at most. No null nodes.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = freeze(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        nearest = _nearest(large)
        small = large.join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = freeze(small.union(nearest.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        found = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    tops = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
