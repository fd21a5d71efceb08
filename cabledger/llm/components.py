"""Connected components of a graph held as rows, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cabledger.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.unionByName(turned)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is hung on the least of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return (around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are hung on the least of them. Edges point from higher to lower."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the least node that can be reached.

    ``edges`` holds links of BIGINT nodes in the columns ``a`` and ``b``, in either direction; repeats, loops and
    nulls are harmless. Rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder, and its fingerprint (count and hash sum) ends the loop when nothing moved.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .filter("u is not null and v is not null and u <> v").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
        now = materialize(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
