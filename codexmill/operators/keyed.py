"""Operators on keyed rows: upsert, dedup, first match, quotas, budgets, tenants.

Each takes and returns DataFrames and is lazy. Every ranking takes a total order,
so results do not depend on how rows are dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

NIL_TENANT = "00000000-0000-0000-0000-000000000000"


def spread(rows: DataFrame, by: str, each: int) -> DataFrame:
    """``rows`` dealt by ``by`` to as many tasks as hold about ``each`` of them, and no fewer than the session's number.

    For steps that make much of few bytes: a stated number is not made smaller, and what a task holds does not grow with the table.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    return rows.repartition(n, by)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key (Spark limits each group before the shuffle)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both; of each key that of the highest ``version``, on a tie the delta's."""
    both = base.withColumn("_delta", F.lit(0)).unionByName(delta.withColumn("_delta", F.lit(1)), allowMissingColumns=True)
    return top_per_key(both, keys, [F.col(version).desc(), F.col("_delta").desc()]).drop("_delta")


def patch(base: DataFrame, delta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` taken from ``delta`` where that has a value; other columns and rows stay."""
    new = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return base.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``delta`` whose key it lacks; null keys equal null."""
    known = base.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return base.unionByName(delta.join(known, same, "left_anti"))


def first_match(items: DataFrame, rules: DataFrame, matches: Column, item_keys: list[str], rank: list[str]) -> DataFrame:
    """Each item with the first rule that matches, by ``rank``; items that none matches have nulls.

    An item meets a rule by any predicate; Spark broadcasts the side that it finds small.
    """
    hits = items.select(*item_keys, *[c for c in items.columns if c not in item_keys]).join(rules, matches, "left")
    return top_per_key(hits, item_keys, [F.col(c).asc_nulls_last() for c in rank])


def running_before(rows: DataFrame, keys: list[str], order: list[str], amount: str, name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the rows of its key that come before, in two levels.

    Rows are dealt by ranges of key and order, so a key with most rows is dealt to
    many tasks; each range is summed on its own, and a window over the ranges' sums, of which a key has no more
    than there are ranges, says what came before each range. ``order`` is total in a key.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *keys).agg(F.sum(amount).alias("_sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(earlier(Window.partitionBy(*keys).orderBy("_range"))), F.lit(0))
    offsets = sums.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_offset"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_range") == F.col("_r"))
    own = F.coalesce(F.sum(amount).over(earlier(Window.partitionBy("_range", *keys).orderBy(*order))), F.lit(0))
    return dealt.withColumn("_own", own).join(offsets, same).withColumn(name, F.col("_own") + F.col("_offset")).select(*rows.columns, name)


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, cap: int) -> DataFrame:
    """Rows in order while the length so far is at most ``cap``; the row that passes it is cut and ends its key.

    Only keys, order and lengths are dealt and summed; texts are joined to the rows
    that are kept. ``order`` is total in a key; a null text has no length.
    """
    lengths = df.select(*keys, *order, F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_length"))
    kept = written(running_before(lengths, keys, order, "_length", "_before").where(F.col("_before") <= cap), "kept")
    names = [*keys, *order]
    place = kept.select(*[F.col(c).alias(f"_k_{c}") for c in names], "_before")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in names])
    left = F.greatest(F.lit(cap) - F.col("_before"), F.lit(0)).cast("int")
    return df.join(place, same).withColumn(text, F.substr(text, F.lit(1), left)).select(df.columns)


def tenant_scope(df: DataFrame, column: str, tenant: str | None, is_admin: bool) -> DataFrame:
    """Rows a user may see: an admin all, others those of their tenant, those without a tenant none."""
    if is_admin:
        return df
    return df.where(F.col(column).cast("string") == F.lit(tenant or NIL_TENANT))


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def sharing(rows: DataFrame, by: str, words: str) -> DataFrame:
    """``(a, b)``: all ordered pairs of rows with equal ``by`` that share a word, each once; structs of the rows' other columns.

    Rows with the same words are a class. Classes meet on their words, two of them only under
    the first word they share, and rows join the pairs of their classes: pairs of rows are
    made once, where they are joined, and never dealt or compared with each other.
    """
    own = rows.where(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.array_sort(F.array_distinct(words)).alias("_words"), F.struct(*[c for c in rows.columns if c not in (by, words)]).alias("row"))
    one = own.select("_by", "_words").distinct().withColumn("_word", F.explode("_words"))
    met = one.join(one.withColumnRenamed("_words", "_other"), ["_by", "_word"]).where(F.get(F.array_intersect("_words", "_other"), F.lit(0)) == F.col("_word"))
    asked = own.withColumnRenamed("row", "a").join(met.drop("_word"), ["_by", "_words"]).select("_by", F.col("_other").alias("_words"), "a")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(n, "_by", "_words")  # a stated number is not made smaller: few bytes go in, many rows come out
    return asked.join(own.withColumnRenamed("row", "b"), ["_by", "_words"]).select("a", "b")


def nearest_in_plane(points: DataFrame, key: str, x: str, y: str, k: int, cell: float) -> DataFrame:
    """``(key, other, rank)``: the ``k`` nearest other points, ties by key, by the quadtree.

    A grid of one ``cell`` puts as many points into a cell as the table is large; the
    tree needs no width, and ``cell`` stays only for callers that give one.
    """
    from . import plane

    return plane.nearest(points, key, x, y, k)
