"""Connected components of an undirected graph whose nodes are integers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component.

    `edges` has integer columns a and b. Each round links every node's larger neighbours
    to its smallest one (large star), then its smaller ones (small star). The number of
    rounds grows with the logarithm of the graph's size. Each half round is stored, so
    its joins are between plain tables and Spark can split large neighbourhoods.
    """
    edges = stored(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = stored(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct())
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")))
        moved = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stored(moved.unionAll(least.select(F.col("m").alias("a"), "b")).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
