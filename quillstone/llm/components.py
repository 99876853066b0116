"""Connected components by alternating stars, in Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def components(links: DataFrame) -> DataFrame:
    """Columns ``node, root`` for every node of ``links`` (long columns ``a, b``): the smallest node it reaches.

    Large star: a node hands its larger neighbours its smallest one; small star: a node hands
    its smaller neighbours and itself the smallest.  Rounds grow with the logarithm of the
    longest path.  A hub meets its links in a minimum, which combines before the shuffle, and in
    a plain join, which adaptive execution splits.  Each round is written to the shared folder.
    """
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialise(pairs.distinct(), "links")
    seal = _seal(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u != v").distinct(), "links")
        before, seal = seal, _seal(edges)
        if seal == before:
            break
    # every node but the roots now has one link, to its root
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _seal(edges: DataFrame) -> tuple:
    """Count and order-free hash of the links, one row."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
