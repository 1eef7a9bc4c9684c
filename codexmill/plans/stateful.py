"""Audit, limiter, job, graph and evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import load
from ..operators import audit, graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS demand FROM events
""")
def sliding_window_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.demand(load(spark, sf_dir, "events"), "user_id", "ts", 86400).select("event_id", "demand")


#: Hits of users and the admissions a limiter makes of them, hit by hit: three errors and ten others in three days.
LIMIT_SQL = """
WITH RECURSIVE h AS (SELECT event_id AS id, user_id::varchar AS ip, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS rule, CASE WHEN event_type = 'error' THEN 3 ELSE 10 END AS most, epoch_us(ts) AS us FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY ip, rule ORDER BY us, id) AS nth FROM h),
s AS (
  SELECT id, ip, rule, nth, [us] AS admitted, TRUE AS ok, NULL::bigint AS wait FROM n WHERE nth = 1
  UNION ALL
  SELECT id, ip, rule, nth, CASE WHEN len(kept) < most THEN list_append(kept, us) ELSE kept END, len(kept) < most, CASE WHEN len(kept) >= most THEN (kept[1] + 259200000000 - us) // 1000000 + 1 END
  FROM (SELECT n.*, list_filter(s.admitted, lambda t: t >= n.us - 259200000000) AS kept FROM s JOIN n ON n.ip = s.ip AND n.rule = s.rule AND n.nth = s.nth + 1)
)
"""
LIMITS = "values (1, 'POST', 'error', 3, 259200), (2, 'POST', '', 10, 259200) as t(rule, method, prefix, max_hits, window_s)"


@query(LIMIT_SQL + "SELECT id, ip, rule, ok AS admitted, wait::int AS retry_after FROM s")
def rate_limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions of all events: three errors and ten other events in three days for each user."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), F.lit("POST").alias("method"), F.col("event_type").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return audit.rate_limit(e, spark.sql(LIMITS))


CHAIN_SQL = """
WITH RECURSIVE e AS (SELECT user_id::varchar AS user_id, event_id, event_id || '|' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
chain AS (
  SELECT user_id, event_id, nth, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS entry_hash FROM e WHERE nth = 1
  UNION ALL SELECT e.user_id, e.event_id, e.nth, e.payload, c.entry_hash, sha256(c.entry_hash || '|' || e.payload) FROM chain c JOIN e ON e.user_id = c.user_id AND e.nth = c.nth + 1
)
"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload"))
    return audit.chain_append(e, "user_id", "event_id", "payload")


@query(CHAIN_SQL + "SELECT user_id, event_id, prev_hash, entry_hash FROM chain")
def audit_chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash chain for each user."""
    return chained(spark, sf_dir).select("user_id", "event_id", "prev_hash", "entry_hash")


@query(CHAIN_SQL + """, edited AS (
  SELECT user_id, event_id, CASE WHEN user_id = '3' AND nth = 5 THEN 'edited' ELSE payload END AS payload, prev_hash, CASE WHEN user_id = '5' AND nth = 2 THEN NULL ELSE entry_hash END AS entry_hash
  FROM chain WHERE NOT (user_id = '4' AND nth = 7)
), marked AS (
  SELECT *, row_number() OVER w AS k, entry_hash = sha256(prev_hash || '|' || payload) AND prev_hash = coalesce(lag(entry_hash) OVER w, repeat('0', 64)) AS ok FROM edited WHERE entry_hash IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
)
SELECT user_id, coalesce(min(k) FILTER (NOT ok) - 1, count(*)) AS n_valid, min(event_id) FILTER (NOT ok) AS first_broken, count(*) AS n_chained FROM marked GROUP BY user_id
""")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which one has an edited row, one a deleted row and one a row without a hash."""
    from pyspark.sql import Window

    c = chained(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    c = c.where("not (user_id = '4' and nth = 7)").withColumn("payload", F.when((F.col("user_id") == "3") & (F.col("nth") == 5), "edited").otherwise(F.col("payload")))
    c = c.withColumn("entry_hash", F.when(~((F.col("user_id") == "5") & (F.col("nth") == 2)), F.col("entry_hash")))
    return audit.chain_verify(c, "user_id", "event_id", ["payload"])


@query("""
WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status, CASE WHEN event_type IN ('view', 'click') THEN event_type || (event_id % 3) END AS stage FROM events),
s AS (SELECT user_id, string_agg(stage, ',' ORDER BY since, stage) AS stages FROM (SELECT user_id, stage, min(event_id) AS since FROM j WHERE stage IS NOT NULL GROUP BY ALL) GROUP BY user_id),
l AS (SELECT user_id, max_by(status, event_id) AS status, max(event_id) AS last_seq FROM j GROUP BY user_id)
SELECT user_id, status, last_seq, coalesce(stages, '') AS stages, status IN ('done', 'failed') AS ended FROM l LEFT JOIN s USING (user_id)
QUALIFY NOT ended OR row_number() OVER (PARTITION BY ended ORDER BY last_seq DESC) <= 100
""")
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job states folded from events; of the finished ones the 100 latest stay in the registry."""
    from ..operators.keyed import top_per_key

    status = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("running")
    stage = F.when(F.col("event_type").isin("view", "click"), F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    e = load(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"), stage.alias("stage"))
    jobs = audit.lifecycle(e, "user_id", "event_id", "status", "stage").select("user_id", "status", "last_seq", "stages", "ended")
    return jobs.where("not ended").unionByName(top_per_key(jobs.where("ended"), ["ended"], [F.col("last_seq").desc()], 100))


@query("""
WITH d AS (SELECT *, greatest(0, coalesce(7200000000 - (epoch_us(ts) - epoch_us(lag(ts) OVER w)), 0)) AS wait_us, coalesce(max(event_type = 'error' AND value > 49) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS disabled FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, wait_us, disabled FROM d
""")
def throttle_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits for one hit in two hours, and a breaker that an earlier hard failure opens."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = audit.waits(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", 1 / 7200)
    return e.select("event_id", "wait_us", F.coalesce(F.max((F.col("event_type") == "error") & (F.col("value") > 49)).over(w), F.lit(False)).alias("disabled"))


# ---- graph

@query("""
WITH e AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 9000)
SELECT n_nationkey, n_name, (SELECT count(*) FROM (SELECT a FROM e UNION SELECT b FROM e)) AS n_linked FROM nation WHERE n_nationkey NOT IN (SELECT a FROM e UNION SELECT b FROM e) AND EXISTS (SELECT 1 FROM e)
""")
def graph_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations at no end of any link, and how many are."""
    s, c = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "customer").where("c_acctbal > 9000")
    e = s.join(c, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
    linked = e.select("a").union(e.select("b")).distinct().agg(F.count(F.lit(1)).alias("n_linked"))
    return graph.isolated(load(spark, sf_dir, "nation"), e, "n_nationkey").select("n_nationkey", "n_name").join(F.broadcast(linked))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS tenant, o_custkey AS a, o_orderkey * 7 % 1500 AS b FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'),
ways AS (SELECT tenant, a, b FROM e UNION SELECT tenant, b, a FROM e),
walk AS (SELECT c_custkey AS src, c_nationkey AS tenant, c_custkey AS node, 0 AS hops FROM customer WHERE c_custkey % 50 = 0 UNION SELECT w.src, w.tenant, ways.b, w.hops + 1 FROM walk w JOIN ways ON ways.a = w.node AND ways.tenant = w.tenant WHERE w.hops < 5)
SELECT src, node, min(hops) AS hops FROM walk GROUP BY ALL
""")
def bounded_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest hops, up to five, from every fiftieth account over the edges of its tenant, which is the account's nation."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("tenant"))
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") * 7 % 1500).alias("b"))
    return graph.hops(o.join(c, "a"), c.where("a % 50 = 0").withColumnRenamed("a", "src"), 5, "tenant")
