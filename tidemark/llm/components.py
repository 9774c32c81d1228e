"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored_copy


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 31)), F.lit(0))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u long, v long); root is the smallest node reachable.

    Each round hangs neighbours under the smallest node in reach, so the number of rounds grows with
    the logarithm of the longest path. A hub is handled by a minimum combined before the shuffle and
    a join, which may split; no node's neighbours meet in one task. Rounds are written out, which
    cuts the lineage. No edges: no rows.
    """
    edges = stored_copy(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        large = stored_copy(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v"))))
        oriented = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = stored_copy(oriented.where("u != v").distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
