"""Graph operators on edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .keyed import insert_if_absent, sharing, symmetric


def merge_edges(edges: DataFrame, vertices: DataFrame, create_targets: bool) -> tuple[DataFrame, DataFrame]:
    """``(edges, vertices)``: distinct edges whose source exists; missing targets become vertices, or drop the edge."""
    known = vertices.select(F.col("id").alias("src"))
    kept = edges.select("src", "rel", "dst").distinct().join(known, "src", "left_semi")
    if not create_targets:
        return kept.join(known.withColumnRenamed("src", "dst"), "dst", "left_semi"), vertices
    return kept, insert_if_absent(vertices, kept.select(F.col("dst").alias("id")).distinct(), ["id"])


def superior(cites: DataFrame, is_decision) -> DataFrame:
    """Documents cited by documents stand above them: non-decision citations reversed, once."""
    return cites.where(~is_decision(F.col("src"))).where("src <> dst").select(F.col("dst").alias("src"), F.lit("SUPERIOR_TO").alias("rel"), F.col("src").alias("dst")).distinct()


def isolated(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes at no end of any edge; none where there are no edges at all."""
    ends = symmetric(edges, "a", "b").select(F.col("a").alias(key)).distinct()
    return nodes.join(ends, key, "left_anti").join(ends.limit(1).select(F.lit(1).alias("_any")), how="left_semi")


#: Sources in a row of a walk: as many bits in each of so many numbers.
WORDS, BITS = 8, 64


def hops(edges: DataFrame, sources: DataFrame, depth: int, tenant: str | None = None) -> DataFrame:
    """``(src, node, hops)``: fewest undirected hops, up to ``depth``, from each source.

    A frontier join a hop; nodes reached before are left out, so a step costs the
    frontier's edges, not all paths. Sources walk in blocks: a row is a node and a block, with a bit
    for each source that is there, so an edge is walked once for a block. Each frontier is written, so
    the plan of a step is one join. With ``tenant``, a column of both tables, a source walks only its tenant's edges;
    of one with several tenants the fewest hops in any of them count. Bits become rows without a join: a block meets the list of
    its sources, of which words without any bit are left out.
    """
    scope = [tenant] if tenant else []
    both = written(edges.select("a", "b", *scope).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *scope)).distinct(), "edges")
    known = sources.select("src", *scope).distinct()
    known = written((known.repartition(*scope).sortWithinPartitions(*scope) if scope else known).withColumn("_n", F.monotonically_increasing_id()), "sources")
    known = known.withColumns({"_block": F.floor(F.col("_n") / (WORDS * BITS)), "_word": (F.col("_n") % (WORDS * BITS) / BITS).cast("int"), "_bit": (F.col("_n") % BITS).cast("int")})
    masks, place = [f"_m{i}" for i in range(WORDS)], [*scope, "node", "_block"]
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    start = known.withColumn("node", F.col("src")).groupBy(*place).agg(*[F.bit_or(F.when(F.col("_word") == i, one).otherwise(F.lit(0).cast("long"))).alias(m) for i, m in enumerate(masks)])
    frontiers = [written(start, "frontier")]
    for _ in range(depth):
        walked = frontiers[-1].withColumnRenamed("node", "a").join(both, ["a", *scope]).withColumnRenamed("b", "node").select(*place, *masks, F.lit(True).alias("_new"))
        rows = walked.unionByName(reduce(DataFrame.unionByName, frontiers).select(*place, *masks, F.lit(False).alias("_new")))
        bits = lambda m, new: F.coalesce(F.bit_or(F.when(F.col("_new") == new, F.col(m))), F.lit(0).cast("long"))
        left = rows.groupBy(*place).agg(*[bits(m, True).bitwiseAND(F.bitwise_not(bits(m, False))).alias(m) for m in masks])
        frontiers.append(written(left.where(reduce(lambda x, y: x | y, [F.col(m) != 0 for m in masks])), "frontier"))
    every = reduce(DataFrame.unionByName, [f.withColumn("hops", F.lit(step)) for step, f in enumerate(frontiers)])
    listed = lambda at, value: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])  # noqa: E731  places are gapless from 0
    held = known.groupBy("_block", "_word").agg(listed("_bit", "src").alias("held")).groupBy("_block").agg(listed("_word", "held").alias("words"))
    found = every.join(held, "_block").select("node", "hops", F.array(*masks).alias("_masks"), F.posexplode("words").alias("_word", "held"))
    found = found.select("node", "hops", F.get("_masks", F.col("_word")).alias("_mask"), "held").where("_mask <> 0")
    found = found.select("node", "hops", "_mask", F.posexplode("held").alias("_bit", "src")).where(F.call_function("getbit", "_mask", F.col("_bit")) == 1)
    found = found.select("src", "node", "hops")
    several = written(known.groupBy("src").count().where("count > 1").select("src"), "several")
    if several.isEmpty():
        return found
    return found.join(several, "src", "left_anti").unionByName(found.join(several, "src", "left_semi").groupBy("src", "node").agg(F.min("hops").alias("hops")))


def document_relations(laws: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, vertices)`` of ``laws(name, revokes, amends, amended_by)``, the last three arrays of names.

    ``REVOKES`` and ``AMENDS`` lead from the law to its targets; an ``AMENDS`` of
    ``amended_by`` leads from the other law to it. Both ends become vertices; a law
    without any relation makes none.
    """
    arm = lambda column, rel: laws.select("name", F.lit(rel).alias("rel"), F.explode(column).alias("other"))
    out = arm("revokes", "REVOKES").unionByName(arm("amends", "AMENDS")).select(F.col("name").alias("src"), "rel", F.col("other").alias("dst"))
    edges = out.unionByName(arm("amended_by", "AMENDS").select(F.col("other").alias("src"), "rel", F.col("name").alias("dst"))).where("src is not null and dst is not null").distinct()
    return edges, edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def newer_than(members: DataFrame) -> DataFrame:
    """``(src, rel, dst)``: of two laws of a region that share a word, the one of the later year stands before the other.

    ``members(region, name, year, words)``. Pairs are made once, so only those of a name with several
    rows are compared with each other; rows are worked out once, and where no name has several, pairs are joined once.
    """
    rows = members.select("region", "name", "year", F.array_sort(F.array_distinct("words")).alias("words")).distinct()
    rows = written(rows.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1), "laws")
    pairs = sharing(rows, "region", "words").where("a.year > b.year")
    named = lambda found: found.select(F.col("a.name").alias("src"), F.lit("NEWER_THAN").alias("rel"), F.col("b.name").alias("dst"))
    if rows.where("many").isEmpty():
        return named(pairs)
    once, again = pairs.where("not a.many and not b.many"), pairs.where("a.many").unionByName(pairs.where("not a.many and b.many"))
    return named(once).unionByName(named(again).distinct())
