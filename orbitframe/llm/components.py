"""Connected components by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.shared import checkpointed


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each vertex's neighbours (its smaller ones, or its larger ones) are tied to its smallest neighbour or itself."""
    if small:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a key of its own gives the aggregate an exchange of its own, so that Spark can split the arcs of a frequent vertex
    joined = arcs.join(least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("u"), "m"), "u")
    if small:
        tied = joined.select(F.col("v").alias("x"), "m").unionAll(least.select(F.col("u").alias("x"), "m"))
    else:
        tied = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("x"), "m")
    return tied.where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges a-b, the component being its smallest id.

    Each round ties larger neighbours, then smaller ones, to the smallest; the number of rounds grows with the
    logarithm of the longest path.  The arcs of a vertex with very many are summed up before they are
    dealt out, and split by Spark where they are joined to the sum.
    """
    edges = checkpointed(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct())
    state = None
    while True:
        edges = checkpointed(_stars(_stars(edges, small=False), small=True))
        row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if row == state:
            break
        state = row
    linked = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return linked.unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
