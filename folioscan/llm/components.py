"""Connected components by alternating large and small stars.

Kiveris et al., Connected Components in MapReduce and Beyond (SoCC 2014). A
round is two exchanges over the edges; rounds grow with the logarithm of the
longest path. A node's smallest neighbour is an aggregate, summed up before
its exchange, and joined back in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with m, the least of each u.

    The join takes a hash of u as a second key, so that both sides are
    exchanged for it alone: only then can Spark split the partition of a node
    with very many neighbours (adaptive skew joins). A join on u alone would
    take over the aggregate's partitioning, which can't be split.
    """
    twice = lambda df: df.withColumn("h", F.xxhash64("u"))
    return twice(edges).join(twice(least), ["u", "h"]).drop("h")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours with the smallest of them (edges run from larger to smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = _with_least(edges, least)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u and v): root is the smallest node that can be reached.

    Edges with a null end and from a node to itself say nothing. No edges, no rows.
    """
    e = materialise(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, last = state, e
        e = materialise(_small_star(_large_star(last)), "edges")
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
