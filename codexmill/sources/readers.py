"""Sources: nested Parquet, JSON lines, Markdown folders, feeds, indexes, guarded SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: Version of the stored index layout.
INDEX_VERSION = 1
#: Parts of a parsed query that read and change nothing; all others, commands among them, are refused.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join UnresolvedWith UnresolvedRelation UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedInlineTable SubqueryAlias UnresolvedSubqueryColumnAliases "
    "Sort GlobalLimit LocalLimit Offset Union Distinct Except Intersect UnresolvedHaving OneRowRelation LocalRelation Window WithWindowDefinition Generate LateralJoin Pivot Unpivot Sample".split()
)
#: Expressions that hold a plan, table functions without a source of their own, and functions that reach out of the query.
SUBQUERIES = frozenset("ScalarSubquery Exists ListQuery LateralSubquery".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())
CALLS_OUT = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())


def decisions(spark: SparkSession, path: str, least: int = 60) -> DataFrame:
    """``(id, pos, title, content)`` of nested decisions: paired tag and value arrays, short sections left out."""
    d = spark.read.parquet(path).select("id", F.posexplode(F.arrays_zip("paragraphs.tag", "paragraphs.value")).alias("pos", "p"))
    return d.select("id", "pos", F.col("p.tag").alias("title"), strip(F.col("p.value")).alias("content")).where(F.length("content") >= least)


def statutes(laws: DataFrame, articles: DataFrame, status: str = "berlaku", least: int = 3) -> DataFrame:
    """Laws in force with their articles in order, as one nested row; one join in place of a query a law."""
    body = articles.groupBy("law_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "number", "text"))), lambda x: F.struct(x["number"].alias("number"), x["text"].alias("text"))).alias("articles"))
    return laws.where(F.col("status") == status).join(body, F.col("id") == F.col("law_id")).where(F.size("articles") >= least).drop("law_id")


def jsonl(spark: SparkSession, folder: str, schema: str, name: str | None = None) -> DataFrame:
    """All ``*.jsonl`` rows of a folder with their ``file``, or those of one file; malformed lines are null rows."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl").json(folder)
    df = df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.where(F.col("file") == name) if name else df


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file: ``(file, text)``."""
    df = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))


def feed_items(feeds: DataFrame, xml: str, most: int = 10) -> DataFrame:
    """Items of RSS texts, at most ``most`` a feed; items without a link are left out."""
    parsed = F.from_xml(F.col(xml), "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING>>>")
    return feeds.select("*", F.explode(F.slice(parsed["channel"]["item"], 1, most)).alias("i")).where("i.link is not null").select(*feeds.columns, "i.title", "i.link", "i.pubDate").drop(xml)


def first_source(*candidates: Column) -> Column:
    """The first list of candidates that isn't null or empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates])


def save_manifest(spark: SparkSession, path: str, count: int) -> None:
    """Marks what was written under ``path`` as whole; written last, so a broken write is never valid."""
    spark.range(1).select(F.lit(INDEX_VERSION).alias("version"), F.lit(count).cast("long").alias("count")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def stored_count(spark: SparkSession, path: str) -> int | None:
    """The document count in the manifest of a finished index of this version, else None."""
    try:
        m = spark.read.parquet(f"{path}/manifest").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return m["count"] if m and m["version"] == INDEX_VERSION else None


def save_index(index: DataFrame, path: str, count: int) -> None:
    """An index and its manifest."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    save_manifest(index.sparkSession, path, count)


def load_index(spark: SparkSession, path: str, count: int) -> DataFrame | None:
    """The stored index if its version and document count are those asked for, else None (rebuild)."""
    return spark.read.parquet(f"{path}/index") if stored_count(spark, path) == count else None


def without_comments(statement: str) -> str:
    """``--``, ``//`` and ``/* */`` comments blanked in one pass that steps over literals and quoted names."""
    token = r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`|--[^\n]*|//[^\n]*|/\*.*?\*/"""
    return re.sub(token, lambda m: m[0] if m[0][0] in "'\"`" else " ", statement, flags=re.S)


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def refused(spark: SparkSession, statement: str, views: Iterable[str]) -> str | None:
    """Why a statement may not run, judged on the plan that the session's own parser makes of it; None if it may.

    Allowed are query plans only, whose relations are ``views`` or the statement's own
    common table expressions, each in its scope; no files, no other tables, no
    functions that call out.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # noqa: BLE001
        return f"not a single query: {str(e).splitlines()[0]}"
    queue = [(plan, frozenset(v.lower() for v in views))]
    while queue:
        node, known = queue.pop()
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            return f"{kind} is no part of a query"
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                queue.append((pair._2(), known))
                known |= {pair._1().lower()}
        elif kind == "UnresolvedRelation":
            name = list(_items(node.multipartIdentifier()))
            if len(name) != 1 or name[0].lower() not in known:
                return f"{'.'.join(name)} is no view of this surface"
        elif kind == "UnresolvedTableValuedFunction":
            if (name := ".".join(_items(node.name())).lower()) not in TABLE_FUNCTIONS:
                return f"table function {name}"
        queue += [(child, known) for child in _items(node.children())]
        expressions = list(_items(node.expressions()))
        while expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction" and (name := ".".join(_items(e.nameParts())).lower()) in CALLS_OUT:
                return f"function {name}"
            if kind in SUBQUERIES:
                queue.append((e.plan(), known))
            expressions += list(_items(e.children()))
    return None


def read_only(spark: SparkSession, statement: str, views: Iterable[str] = (), cap: int = 500) -> DataFrame:
    """A query over registered ``views``, at most ``cap`` rows; anything else raises ``ValueError``. Comments are blanked first."""
    plain = without_comments(statement).strip().rstrip(";")
    if why := refused(spark, plain, views):
        raise ValueError(f"only a single SELECT over the views is allowed: {why}")
    return spark.sql(plain).limit(cap)
