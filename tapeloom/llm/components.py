"""Connected components of a graph held in a DataFrame, by alternating large and small stars.

Every round is a handful of shuffles on node ids and its result is checkpointed to the shared folder,
so a lost executor costs one round at most and nothing is gathered on the driver but a row count; no side of a join is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import shuffled


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs (u, v), u > v. Links every neighbour of a node to the smallest one.

    The minimum is aggregated before it is joined back, so a node with very many neighbours
    is combined map-side and its rows may be split by the skew join.
    """
    around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    joined = around.join(shuffled(least), "u")
    if large:
        linked = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (a, b), longs, the smallest node that it reaches."""
    pairs = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
        .checkpoint()
    )
    for _ in range(most_rounds):
        after = _star(_star(pairs, True), False).checkpoint()
        moved = after.join(shuffled(pairs), ["u", "v"], "left_anti").limit(1).count()
        same = not moved and after.count() == pairs.count()
        pairs = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())
