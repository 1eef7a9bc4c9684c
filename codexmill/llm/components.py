"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node hands its larger (or smaller) neighbours to the least node it knows.

    The least neighbour is aggregated on the map side and joined back; adaptive
    execution splits the join of a node with very many links.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its least node.

    Alternating large-star and small-star steps until nothing changes; each round
    is written to the shared folder, so a lost executor repeats one round at most,
    and the round before is removed.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while True:
        last, edges = edges, written(_stars(_stars(edges, True), False), "stars")
        removed(last)
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    # Now every node points at the least of its component.
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select("b", "b").toDF("node", "component").distinct())
    out = written(found, "components")
    removed(edges)
    return out
