"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames; each round is written to the shared folder, so the lineage
never grows and a lost executor repeats one round at most; a round's files go when the next one
is written.  The number of rounds grows with the logarithm of the longest path.

Defined results: links with a null end and loops are left out; repeated links count once; no links
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MAX_ROUNDS = 60


def _summary(edges: DataFrame) -> tuple[int, int]:
    # edges are distinct, so none cancels another; a sum of hashes would overflow past a million edges
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(least, "a").where(F.col("b") > F.col("a"))
    return joined.select(F.col("b").alias("a"), F.least("m", F.col("a")).alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    down = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the component's smallest node) of every node that has a link.

    ``links`` has two columns of numbers; direction, repeats and loops don't matter.
    """
    one, two = (F.col(f"`{c}`") for c in links.columns[:2])
    edges = links.select(F.greatest(one, two).alias("a"), F.least(one, two).alias("b")).where("a != b").distinct()
    edges, path = written(edges, "edges")
    before = _summary(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        after, place = written(_small_star(_large_star(edges)), "edges")
        now = _summary(after)
        discard(links.sparkSession, path)
        edges, path = after, place
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
