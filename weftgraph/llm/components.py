"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b long) reaches.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself to
    the smallest. Each step is one aggregation and one join; the edge table is
    written after each round, so neither lineage nor a driver list grows.
    Nodes without an edge are absent.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = scratch.save(
            both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .where("v <> u").distinct(), "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        after = scratch.save(
            small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "small")
        same = not after.exceptAll(now).take(1) and not now.exceptAll(after).take(1)
        scratch.drop(now, large)
        now = after
        if same:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
                now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
