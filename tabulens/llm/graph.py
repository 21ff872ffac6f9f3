"""Connected components over an edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


EDGES_PER_TASK = 200_000


def _mins(directed: DataFrame) -> DataFrame:
    """Smallest of each node and its neighbours; aggregated before the shuffle, so a hub is cheap."""
    return directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node.

    Alternating large-star and small-star steps: every round links each node to smaller ones
    only, so a chain shrinks by a constant factor and a hub never gathers its neighbours in one
    task (minimums are partial aggregates, and the joins are plain equi-joins that Spark may
    split). Self loops, repeated edges and null ends are ignored; without edges the result is empty.
    """
    cur = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    before = None
    # as many tasks as the edges need: a small graph would otherwise write mostly empty files
    parts = max(1, math.ceil(cur.count() / EDGES_PER_TASK))
    cur = cur.coalesce(parts)
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_mins(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = cut_lineage(large.where("a <> b").coalesce(parts)).distinct()  # every edge now points to a smaller node
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        cur = cut_lineage(small.where("a <> b").distinct().coalesce(parts))
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return cut_lineage(nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct()))
        before = (now["n"], now["h"])
    raise RuntimeError("components did not settle")
