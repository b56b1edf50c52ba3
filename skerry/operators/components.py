"""Connected components by alternating large-star and small-star steps.

Each step rewires every node to the least neighbour it knows; a few steps turn each component into one star
around its least node. Work per step is linear in the edges, and no node's neighbours are ever gathered: the
minimum of a hub is aggregated map-side, and the join back to its edges deals both sides, so that AQE can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _dealt_again(least: DataFrame) -> DataFrame:
    """The same rows, but their partitioning by u is hidden: a join then shuffles them and the edges alike."""
    same = F.concat("u", F.lit("")) if dict(least.dtypes)["u"] == "string" else F.expr("u + 0")
    return least.withColumn("u", same.cast(dict(least.dtypes)["u"]))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(_dealt_again(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(_dealt_again(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; the component is its least node.

    `edges` has two columns of one orderable type in any direction; null ends, self-loops and repeats are
    ignored. Each round is cut with a checkpoint, so a lost executor costs one round at most.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = cut(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_steps):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = cut(_small(_large(now)))
    else:
        raise RuntimeError(f"components not settled after {max_steps} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
