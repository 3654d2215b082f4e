"""Connected components of a distributed set of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop_table, work_table


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> node, component (the smallest node reachable); nodes without links are absent.

    A round joins every node to the least of its neighbours: first for the larger neighbours of each node, then for the smaller ones. When a
    round changes nothing, links form stars around the least nodes. Rounds number about the logarithm of the longest path.
    A node with very many neighbours is one row of a partial aggregate and the many side of a join that adaptive execution splits.
    """
    edges = work_table(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = work_table(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        fresh = work_table(small)
        drop_table(edges)
        drop_table(large)
        edges, before = fresh, seen
        seen = mark(edges)
        if tuple(seen) == tuple(before):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
