"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import materialise


def _stars(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each directed edge with the least node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    # Written, so that the join's sides are plain exchanges, which adaptive execution can split at a hot centre.
    return edges.join(materialise(least, "least-nodes"), "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    starred = _stars(down)
    links = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v")))
    return links.where("u <> v").distinct()


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """``node, component`` for every node in ``pairs``; the component is its least node.

    Each round is a large-star and a small-star step; the edges are written
    to the shared folder after a round, and rounds end when the edge set
    stays the same. Rounds grow with the logarithm of the diameter. Joins on
    a star's centre are plain equi-joins, which adaptive execution splits.
    """
    edges = materialise(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("u"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())

    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = materialise(_small(_large(edges)), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
