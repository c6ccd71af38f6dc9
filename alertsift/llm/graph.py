"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstaged


def _large(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("_least"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("u", "_least").alias("v"))
        .distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them. Edges run from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("_least"))
    joined = edges.join(least, "u")
    moved = joined.where(F.col("v") > F.col("_least")).select(F.col("v").alias("u"), F.col("_least").alias("v"))
    return moved.unionByName(least.select("u", F.col("_least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its least node.

    ``edges`` has two columns of ids in either direction; loops and repeats are allowed. Each
    round writes the edge table to the shared folder. It ends when a round changes nothing,
    after about log(longest path) rounds. Hot nodes are joined on a hash-aggregated minimum, so
    adaptive joins may split them and no neighbour list is built.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = staged(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if found == mark or found["n"] == 0:
            break
        mark, before = found, now
        now = staged(_small(_large(before)), "edges")
        unstaged(before)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
