"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.common import durable, join_spread

#: Edges in a partition.
PART_ROWS = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = join_spread(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_spread(down, least, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs, in any order and repeated or not -> (node, component).

    `component` is the smallest node reachable. Only nodes that have an edge to another node are
    returned; an empty edge table gives an empty result. Edge tables are small against what they come
    from, so each is kept in as few partitions as its rows need. Each round contracts every neighbourhood
    onto its smallest member, so a group of any shape ends as a star; the minimum per node is a
    pre-aggregated groupBy and the join that follows can be split by the skew handling, so one huge
    group doesn't gather in a task. Every round is checkpointed.
    """
    spread = F.col("u").cast("decimal(20,0)") + F.col("v").cast("decimal(20,0)") * 3
    seal = [F.count("*").alias("n"), F.sum(spread).alias("s"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v"))
    parts = -(-edges.count() // PART_ROWS) or 1
    current = durable(edges.coalesce(parts).distinct().coalesce(parts))
    before = current.agg(*seal).first()
    while before["n"]:
        current = durable(_small_star(_large_star(current)).coalesce(parts))
        after = current.agg(*seal).first()
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
