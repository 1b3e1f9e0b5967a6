"""Connected components by alternating large-star and small-star steps.

Edges stay in tables under the checkpoint folder; each step is a grouped
minimum joined back to the edges, so a hub's edges are split by AQE's skew
join and never meet in one task. The driver sees one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import stored


def _checksum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(r)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star")
    return (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = stored(edges.groupBy("a").agg(F.min("b").alias("m")), "star")
    out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return out.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (columns a, b: bigint); component is the smallest
    node. Loops, repeated links and either direction are fine; nodes without a link do not appear."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a != b").distinct(), "edges")
    seen = _checksum(edges)
    while seen[0]:
        edges = stored(_small_star(stored(_large_star(edges), "edges")), "edges")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
