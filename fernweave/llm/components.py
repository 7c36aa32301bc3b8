"""Connected components of an undirected graph by alternating large-star and small-star steps.

Edges are columns `u` and `v` of any ordered type. A step groups by a node, takes its smallest
neighbour by an aggregate that is summed map-side, writes it, and joins it back; a hub is a join of two
shuffles that Spark can split, never a list in a task. Each round is a table in the shared folder. The rounds end when a
round changes nothing; they grow with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_since, drop_written, marked, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    near = both.join(least.hint("merge"), F.col("u") == F.col("k"))
    if large:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    kept = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node with an edge, the smallest node that it reaches. Self-loops are left out.

    A round brings each node's smallest neighbour nearer to its component's smallest node or changes nothing, so the
    rounds end by themselves.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    last = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007), F.sum(F.xxhash64("v", "u") % 1_000_000_009)).first()
        if sign == last or sign[0] == 0:
            break
        last, was = sign, now
        mark = marked()
        now = written(_star(_star(now, True), False), "cc")
        drop_since(mark, now)
        drop_written(was)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
