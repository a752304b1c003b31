"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _checksum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of an edge, component being the smallest node it reaches.

    Alternating large-star and small-star steps: every node points its larger neighbours, then
    its smaller ones, at the least of its neighbourhood, until nothing changes, however many
    rounds that takes (at most of the order of the square of the logarithm of the nodes). The minimum is aggregated before the shuffle and joined back, so a hub's
    neighbours are never gathered. Self-loops give components of their own; rows with a null
    end are left out; an empty table gives no rows.
    """
    kept = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes_alone = kept.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    current = settle(kept.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, after = None, _checksum(current)
    while before != after and after[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(floor, "u")
        shortened = pointed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = settle(shortened.unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        before, after = after, _checksum(current)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return found.unionByName(nodes_alone).groupBy("node").agg(F.min("component").alias("component"))
