"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import forget, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node.

    Alternates two steps until the edges are stars around their smallest node.  In the large
    step every node sends its larger neighbours to the smallest node around it; in the small
    step it sends its smaller neighbours there.  Both are one aggregation and one join, the
    rounds grow with the logarithm of the longest path, and each round starts from files in
    the shared folder, where those of earlier rounds are deleted.  Self-loops and repeated edges are allowed; an empty table gives an
    empty result.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        count, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == 0 or (count, total) == before:
            break
        before = (count, total)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join below deals both sides anew and a hub can be split.
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), name)
        # Large step: neighbours above u go to the smallest node around u.
        large = stored(both.where("v > u").join(least, "u")
                       .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), name)
        # Small step: all smaller neighbours of u, and u itself, go to the smallest of them.
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = (large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u > v").distinct())
        last, now = now, stored(small, name)
        forget(last, least, large, low)
    if count == 0:
        return spark.createDataFrame([], "node long, component long")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
