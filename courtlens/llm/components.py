"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours of each node with the least node around it.

    The least neighbour is an aggregate (combined before the shuffle) joined back, so a node with very many neighbours
    is no single task's work: the join's large partitions can be split.
    """
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = pairs.join(least, "u")
    if larger_only:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return (
        joined.where("v <= u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    )


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that can be reached. Only nodes with an edge to another node appear.

    Nulls and loops in the edges are left out; repeated edges count once. An empty table gives an empty table. Rounds
    grow with the logarithm of the longest chain; what isn't done after ``max_rounds`` raises an error.
    """
    now = checkpoint(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = _star(both, True).where("a <> b").distinct()
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).where("a <> b").distinct()
        now = checkpoint(small)
        state = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
            F.countDistinct("a").alias("d"),
        ).first()
        if state == before and state["n"] == state["d"]:
            break
        before = state
    else:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
