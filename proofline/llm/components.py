"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change. Both steps need only the
    minimum of a node's neighbours, which is aggregated before the shuffle, and a join, so that a node with
    very many links is no task's burden. Null ends and links to itself are left out; no links give no rows.
    """
    edges, seen = _kept(_oriented(links.select("a", "b")))
    while seen[0]:
        edges, now = _kept(_small_star(_large_star(edges)))
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _oriented(df: DataFrame) -> DataFrame:
    df = df.where("a is not null and b is not null and a <> b")
    return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Links as a table, and their number and the sum of their hashes, which are taken as they are written."""
    seen = Observation()
    rows, total = F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total")
    edges = written(edges.observe(seen, rows, total))
    return edges, (seen.get["rows"], seen.get["total"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return _oriented(moved.union(least.select("a", F.col("m").alias("b"))))
