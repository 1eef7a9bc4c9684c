"""Queries that rest on a mechanism of the engine's own: table functions, VARIANT, policies, guards, databases, expiring state, progress."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import load
from ..functions import semi
from ..functions.sections import sections
from ..scratch import new_path, setting, written
from ..sources import embedded, readers
from ..streaming import limiter, progress, streams
from .stateful import LIMIT_SQL, LIMITS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- table functions

@query(r"""
WITH l AS (SELECT doc_id, i::int AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
s AS (SELECT *, CASE WHEN words BETWEEN 1 AND 3 THEN 1 WHEN words BETWEEN 4 AND 6 THEN 2 END AS level FROM (SELECT *, len(regexp_extract_all(line, '[^ ]+')) AS words FROM l)),
g AS (SELECT *, count(level) OVER w AS nth, last_value(CASE WHEN level = 1 THEN line END IGNORE NULLS) OVER w AS top FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, min(line_no) AS line_no, max(level)::int AS level, max(line) FILTER (level IS NOT NULL) AS heading,
       max(CASE WHEN level = 2 AND top IS NOT NULL THEN top || ' > ' || line ELSE line END) FILTER (level IS NOT NULL) AS path, coalesce(sum(length(line)) FILTER (level IS NULL), 0)::int AS chars
FROM g WHERE nth > 0 GROUP BY doc_id, nth
""")
def text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents with the path of headings above: a line of one to three words is a heading of the first level, one of four to six of the second."""
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    words = F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0)))
    level = F.when(words.between(1, 3), 1).when(words.between(4, 6), 2)
    return sections(spark, lines.select("doc_id", (F.col("at") + 1).alias("line_no"), level.alias("level"), "line"), "doc_id", "line_no")


# ---- semi-structured values

@query("""
WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN left(props, len(props) - 2) WHEN event_id % 11 = 0 THEN '{"k": "none", "note": "' || event_type || '"}' ELSE props END AS props FROM events)
SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 <> 0 THEN props->>'k' END AS bigint) AS k, CASE WHEN event_id % 7 <> 0 THEN props->>'note' END AS note, event_id % 7 = 0 AS malformed FROM e
""")
def variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of all events typed by VARIANT: every seventh is cut off and stays as null, every eleventh has other types and fields."""
    e = load(spark, sf_dir, "events")
    odd = F.concat(F.lit('{"k": "none", "note": "'), "event_type", F.lit('"}'))
    props = F.when(F.col("event_id") % 7 == 0, F.substr("props", F.lit(1), F.length("props") - 2)).when(F.col("event_id") % 11 == 0, odd).otherwise(F.col("props"))
    rows = e.select("event_id", props.alias("props"))
    return rows.select("event_id", semi.optional(F.col("props"), "k", "bigint").alias("k"), semi.optional(F.col("props"), "note", "string").alias("note"), semi.variant(F.col("props")).isNull().alias("malformed"))


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::bigint) AS k_sum, 'STRUCT<k: BIGINT>' AS found FROM events GROUP BY event_type")
def discovered_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties typed by the schema that all rows show."""
    e = load(spark, sf_dir, "events")
    kind = semi.discovered(e, "props")
    t = semi.typed(e, "props", "p", kind)
    return t.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p.k").alias("k_sum")).withColumn("found", F.lit(kind))


# ---- guarded and scoped SQL

STATEMENT = """
-- a user's own statement; it may hold comments, and literals that look like them
WITH big AS (SELECT o_custkey, o_totalprice AS "set" FROM my_orders WHERE o_totalprice > 100000 /* large ones */)
SELECT c_custkey, count(*) AS n, max(`set`) AS most, 'http://a.b/c--d; drop' AS `use` // trailing
FROM big JOIN my_customer ON c_custkey = o_custkey
WHERE EXISTS (SELECT 1 FROM my_orders p WHERE p.o_custkey = c_custkey AND p.o_orderstatus = 'F')
GROUP BY c_custkey ORDER BY n DESC, c_custkey LIMIT 400;
""".replace('"set"', "`set`")


@query("""
SELECT c_custkey, count(*) AS n, max(o_totalprice) AS most, 'http://a.b/c--d; drop' AS "use" FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_totalprice > 100000 AND c_nationkey IN (1, 3, 5, 7) AND EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c_custkey AND p.o_orderstatus = 'F') GROUP BY c_custkey ORDER BY n DESC, c_custkey LIMIT 400
""")
def guarded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over a tenant's views, judged on its parsed plan."""
    load(spark, sf_dir, "orders").createOrReplaceTempView("my_orders")
    load(spark, sf_dir, "customer").where("c_nationkey in (1, 3, 5, 7)").createOrReplaceTempView("my_customer")
    return readers.read_only(spark, STATEMENT, ["my_orders", "my_customer"])


@query("""
SELECT 'admin' AS viewer, c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000
UNION ALL SELECT 'member', c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 3
""")
def tenant_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an admin, a member of tenant 3 and a user without a tenant see, by session variables and a table function that applies the policy."""
    load(spark, sf_dir, "customer").createOrReplaceTempView("codexmill_customer")
    spark.sql("""
      CREATE OR REPLACE TEMPORARY FUNCTION tenant_customers(tenant STRING, is_admin BOOLEAN) RETURNS TABLE(c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE)
      RETURN SELECT c_custkey, c_nationkey, c_acctbal FROM codexmill_customer WHERE coalesce(is_admin, false) OR c_nationkey = try_cast(tenant AS INT)""")
    spark.sql("DECLARE OR REPLACE VARIABLE viewer_tenant STRING")
    spark.sql("DECLARE OR REPLACE VARIABLE viewer_is_admin BOOLEAN DEFAULT false")
    out = None
    for viewer, tenant, admin in (("admin", "null", "true"), ("member", "'3'", "false"), ("nobody", "null", "false")):
        spark.sql(f"SET VARIABLE (viewer_tenant, viewer_is_admin) = (SELECT {tenant}, {admin})")
        seen = spark.sql(f"SELECT '{viewer}' AS viewer, c_custkey, c_acctbal FROM tenant_customers(viewer_tenant, viewer_is_admin) WHERE c_acctbal > 5000")
        out = seen if out is None else out.unionByName(seen)
    return out


# ---- a database

@query("""
SELECT o_orderkey, o_orderstatus, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'
""")
def database_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status and their customers' names out of a database: ranged scans with the filter pushed down and one join, not a query a row."""
    orders = embedded.write(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "orders", "o_orderkey")
    customers = embedded.write(load(spark, sf_dir, "customer").select("c_custkey", "c_name"), "customer", "c_custkey")
    o = embedded.scan(orders, "orders", "o_orderkey bigint, o_custkey bigint, o_orderstatus string", "o_orderstatus = 'F'")
    c = embedded.scan(customers, "customer", "c_custkey bigint, c_name string")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_orderstatus", "c_name")


# ---- streams and progress

def shuffled_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """All events in four files, each a span of ten days of which every third event comes a file late; a last one ends the time."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), F.lit("POST").alias("method"), F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    span = F.least(F.lit(2), F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 10))
    e = written(e.withColumn("file", span + F.when(F.col("id") % 3 == 0, 1).otherwise(0)), "hits")
    for n in range(4):
        e.where(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(path)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("").alias("ip"), F.lit("POST").alias("method"), F.lit("end").alias("path"), F.lit("2100-01-01").cast("timestamp").alias("ts"))
    end.write.mode("append").parquet(path)


def limited_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Admissions of all events from files out of order."""
    files, out = new_path(spark, "hit-files"), new_path(spark, "stream")
    shuffled_files(spark, sf_dir, files)
    rules = spark.sql(LIMITS).withColumnRenamed("method", "_method")
    hits = spark.readStream.schema(spark.read.parquet(files).schema).option("maxFilesPerTrigger", 1).parquet(files)
    fits = (F.col("method") == F.col("_method")) & F.startswith("path", "prefix")
    # Of the rules that fit the first holds: it has the longer prefix here, and a stream has no window over rows.
    first = hits.join(F.broadcast(rules), fits).where("rule = 1 or path not like 'error%'")
    rows = first.select(F.concat_ws("|", "ip", "rule").alias("key"), "id", "ts", F.col("max_hits").alias("most"), "window_s")
    with setting(spark, *limiter.PROVIDER), setting(spark, "spark.sql.shuffle.partitions", str(max(4, spark.sparkContext.defaultParallelism))):
        return streams.run(limiter.limited(rows, "25 days"), out, "append", name=name).where("id >= 0")


@query(LIMIT_SQL + "SELECT id, ip || '|' || rule AS key, ok AS admitted, wait::int AS retry_after FROM s")
def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admissions of ``rate_limit_events`` from a stream whose hits come out of order, with state that expires."""
    return limited_stream(spark, sf_dir, f"limiter-{uuid.uuid4().hex[:8]}")


@query("""
SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, (SELECT count(*) FROM lineitem) AS rows_seen, (SELECT max(l_orderkey) FROM lineitem) AS last_order,
       CASE WHEN count(*) < (SELECT count(*) FROM lineitem) THEN round(60.0 / count(*) * ((SELECT count(*) FROM lineitem) - count(*)))::bigint END AS eta_s
FROM lineitem GROUP BY l_returnflag
""")
def observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of all line items and, from the same pass, how many rows went by; from these the time left if a flag's rows had taken a minute."""
    derived = lambda rows: rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    out = progress.with_figures(load(spark, sf_dir, "lineitem"), derived, rows_seen=F.count(F.lit(1)), last_order=F.max("l_orderkey"))
    return out.withColumn("eta_s", progress.eta(F.lit(60.0), F.col("n"), F.col("rows_seen")))


@query("SELECT count(*) AS rows_in, count(DISTINCT (time_bucket(INTERVAL 6 HOURS, ts), event_type)) AS state_rows FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listener of a stream over all events has logged when it ends."""
    log = progress.ProgressLog(f"progress-{uuid.uuid4().hex[:8]}")
    spark.streams.addListener(log)
    try:
        events = streams.source(spark, f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
        out = new_path(spark, "stream")
        streams.run(streams.window_counts(events, "ts", "60 days", "6 hours", "event_type"), out, "complete", streams.replace_with(out), name=log.name)
        rows = log.table(spark)
    finally:
        spark.streams.removeListener(log)
    return rows.agg(F.max("total_rows").alias("rows_in"), F.max("state_rows").alias("state_rows"))
