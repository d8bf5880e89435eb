"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.lineage import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    ``edges`` has two columns of the same ordered type.  Self loops only name
    their node; null ends are ignored; repeated edges count once.  Each round is
    a large-star and a small-star step, two aggregations and joins on the node,
    so the number of rounds grows with the logarithm of the longest path.  An
    empty table gives an empty result.
    """
    left, right = edges.columns[:2]
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        around = _both_ways(now)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(below, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        now = cut(small)
        # a star forest has one edge a node, and every centre is no one's leaf
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (after["n"], after["s"]) == mark:
            break
        mark = (after["n"], after["s"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    best = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(best, "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
