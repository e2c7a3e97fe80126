"""Connected components of a link table, by star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import staged


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long ids) to (node, component): the least id each node can reach.

    Each round points every node at the least neighbour of its neighbours (large star, then
    small star); rounds are written to the shared folder, so lineage stays short, and their
    number grows with the logarithm of the longest chain. A hub's links are aggregated by
    minimum before they are joined back, so no node's links meet in one task's memory.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(lower.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        found = staged(small, "links")
        # Done when every link goes from a node to a root: no root has a link of its own upward.
        unsettled = found.select("v").distinct().join(found.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        doubled = found.groupBy("u").count().where("count > 1").limit(1).count()
        edges = found
        if not unsettled and not doubled:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
