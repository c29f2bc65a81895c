"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b bigint); component is the component's least node.

    Alternates large-star and small-star steps until each component is a star around its least node; the
    number of rounds grows with the logarithm of the longest path. Minima are summed up before the shuffle, and the join that
    hands them to a hub's neighbours meets two written tables, so its large partitions can be split. The driver sees one row a round.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = scratch.table(e.distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: neighbours above u go to the least node around u
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its other lower neighbours go to the least of them
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(e, least, large, low)
        e = new
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
