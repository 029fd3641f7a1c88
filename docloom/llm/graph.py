"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _star(neighbours: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours of each node to the least node around it. A node's neighbours meet in a join, not in one list."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = neighbours.join(least, "u")
    kept = joined.where(F.col("v") > F.col("u")) if larger else joined
    pairs = kept.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger:
        pairs = pairs.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node, root: the least node reachable, for every node that has an edge (others are left out).

    Loops, repeated edges and null ends count for nothing. Each round writes its edges to the shared
    folder; it ends when a round changes nothing. Rounds grow with the logarithm of the longest path.
    """
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        large = _star(_both(now), True)
        small = _star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False)
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
