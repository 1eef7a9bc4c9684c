"""Queries of rules, logs and retrieval steps, over tables where they hold such rows, else over rows worked by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import load
from ..functions import legal as L
from ..functions import text as X
from ..operators import audit, containment, evaluation, graph
from ..operators import retrieval as R
from ..operators.keyed import top_per_key
from ..sources import readers
from .retrieval import LEX_EVERY_SQL, LEX_SQL, STOPS_SQL, items, lexical, questions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


# ---- retrieval steps

@query(f"""
WITH {LEX_EVERY_SQL}
SELECT query_id, md5(string_agg(text, chr(10) ORDER BY rank)) AS context, length(string_agg(text, chr(10) ORDER BY rank)) AS chars FROM lex JOIN documents ON doc_id = id WHERE rank < 5 AND text IS NOT NULL GROUP BY query_id
""")
def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each item as one context."""
    c = R.context(lexical(spark, sf_dir, items(spark, sf_dir)), load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return c.select("query_id", F.md5("context").alias("context"), F.length("context").cast("long").alias("chars"))


@query(f"""
WITH {LEX_SQL},
q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: t NOT IN {STOPS_SQL})) AS terms FROM benchmark WHERE item_id % 50 = 0),
d AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(left(coalesce(text, ''), 1500)), '[a-z0-9]+'), lambda t: t NOT IN {STOPS_SQL}) AS terms FROM documents),
s AS (SELECT query_id, id, rank, coalesce(len(list_intersect(q.terms, list_distinct(d.terms))) / nullif(len(q.terms), 0), 0) AS score FROM lex JOIN q USING (query_id) JOIN d USING (id))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank >= 12, CASE WHEN rank < 12 THEN round(score, 9) END DESC, rank) AS pos FROM s
""")
def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical candidates of which the first twelve are ordered anew by the share of the query's terms they hold."""
    q = questions(spark, sf_dir).select("query_id", F.col("text").alias("query_text"))
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    c = lexical(spark, sf_dir).select("query_id", "id", "rank").join(q, "query_id").join(d, "id")
    return R.reranked(c, "overlap", top=12).select("query_id", "id", "pos")


@query(f"""
WITH {LEX_EVERY_SQL}
SELECT query_id, source AS law, doc_id % 7 AS article, doc_id % 7 = query_id // 50 % 7 AS cited FROM lex JOIN documents ON doc_id = id
""")
def feedback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feedback row for each article that an item retrieves; an item without number says of none whether it is cited."""
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law"), (F.col("doc_id") % 7).alias("article"))
    asked = items(spark, sf_dir)
    rows = R.feedback_rows(lexical(spark, sf_dir, asked).select("query_id", "id").join(d, "id"), asked.selectExpr("query_id", "query_id div 50 % 7 as article"))
    return rows.withColumn("cited", F.when(F.col("query_id").isNotNull(), F.col("cited")))


@query(r"""
WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower('passage: ' || coalesce(text, '')), '[^ \t\n\r]+')) AS word FROM documents),
c AS (SELECT id, ('0x' || left(md5(word), 4))::int % 64 AS dim, count(*) AS n FROM w GROUP BY ALL)
SELECT id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM c
""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as passages, by the stand-in embedder; components that are not zero."""
    v = R.embed(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "passage")
    return v.select("id", F.posexplode("vector").alias("dim", "value")).where("value > 0").select("id", "dim", F.round("value", 6).alias("value"))


# ---- pages

# Parts of hosts that are never fetched.
DENIED = [".onion", ".i2p", "darknet", "telegram.", "t.me"]


@query("""
WITH p AS (SELECT page_id, url, page_id % 10 AS request, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages),
ok AS (SELECT * FROM p WHERE url <> '' AND NOT (contains(host, '.onion') OR contains(host, '.i2p') OR contains(host, 'darknet') OR contains(host, 'telegram.') OR contains(host, 't.me')) QUALIFY row_number() OVER (PARTITION BY request, url ORDER BY page_id) = 1)
SELECT request, row_number() OVER (PARTITION BY request ORDER BY ends_with(host, '.org') DESC, page_id) AS pos, page_id, host FROM ok QUALIFY pos <= 5
""")
def ranked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sources a request reads: denied hosts and repeated urls out, preferred hosts first."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    p = load(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 10).alias("request"), host.alias("host"))
    denied = F.exists(F.array(*[F.lit(d) for d in DENIED]), lambda d: F.contains(F.col("host"), d))
    once = top_per_key(p.where(~denied & (F.col("url") != "")), ["request", "url"], [F.col("page_id")])
    w = Window.partitionBy("request").orderBy(F.endswith("host", F.lit(".org")).desc(), "page_id")
    return once.select("request", F.row_number().over(w).alias("pos"), "page_id", "host").where("pos <= 5")


# ---- laws and their relations

@query("""
SELECT DISTINCT o_custkey::varchar AS src, (o_orderkey % 1500)::varchar AS dst FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey % 1500 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def merge_edges_both_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of which both ends are there; nothing is made for a missing one."""
    v = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    e = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.lit("R").alias("rel"), (F.col("o_orderkey") % 1500).cast("string").alias("dst"))
    return graph.merge_edges(e, v, False)[0].select("src", "dst")


@query("""
SELECT 'c' || c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier
""")
def label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that carry one of two labels."""
    c = load(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("Customer"), F.initcap("c_mktsegment")).alias("labels"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("Supplier")).alias("labels"))
    return c.unionByName(s).where(F.arrays_overlap("labels", F.array(F.lit("Building"), F.lit("Supplier")))).select("id", "name")


@query("""
SELECT DISTINCT a.p_partkey AS src, 'NEWER_THAN' AS rel, b.p_partkey AS dst FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size > b.p_size
WHERE len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) > 0
""")
def newer_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newer to older, where two of a region share a word."""
    p = load(spark, sf_dir, "part").select(F.expr("if(p_brand is not null and p_type is not null, struct(p_brand, p_type), null)").alias("region"), F.col("p_partkey").alias("name"), F.col("p_size").alias("year"), F.split("p_name", " ").alias("words"))
    return graph.newer_than(p)


@query(f"""
SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(p_name), '[a-z]{{5,}}'), lambda w: w NOT IN {listed(L.TOPIC_STOPS)}), ',') AS words FROM part
""")
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(L.topic_words(F.col("p_name")), ",").alias("words"))


@query("""
WITH p AS (SELECT DISTINCT pattern FROM (SELECT lower(left(text, 24)) AS pattern FROM benchmark UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM part UNION ALL SELECT left(text, 16) FROM conversations) WHERE pattern <> '')
SELECT pattern, doc_id FROM p JOIN documents ON contains(lower(text), lower(pattern))
""")
def contained_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold the beginnings of benchmark items and conversations, or words of parts' names, in either case."""
    words = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("pattern"))
    starts = load(spark, sf_dir, "benchmark").select(F.lower(F.substring("text", 1, 24)).alias("pattern")).union(load(spark, sf_dir, "conversations").select(F.substring("text", 1, 16)))
    patterns, docs = words.union(starts).where("pattern <> ''"), load(spark, sf_dir, "documents").select("doc_id", "text")
    return containment.contained(patterns, "pattern", docs, "doc_id", "text")


@query("""
WITH p AS (SELECT page_id, page_id % 50 AS request, url, CASE WHEN page_id % 4 = 0 THEN 'api' WHEN page_id % 4 = 1 THEN 'engine' ELSE 'feed' END AS source FROM pages WHERE url <> ''),
up AS (SELECT * FROM p WHERE NOT (source = 'api' AND request % 3 = 0) AND NOT (source = 'engine' AND request >= 20)),
r AS (SELECT *, row_number() OVER (PARTITION BY request, source ORDER BY page_id) AS nth FROM up),
f AS (SELECT request, min(source) AS source FROM up GROUP BY request)
SELECT request, nth::int AS pos, page_id, url FROM r JOIN f USING (request, source) WHERE nth <= 5
""")
def search_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each request from the first source that gives any: an interface that a third of the requests may not use, an engine that failed at the twentieth and stays off, and feeds."""
    source = F.when(F.col("page_id") % 4 == 0, "api").when(F.col("page_id") % 4 == 1, "engine").otherwise("feed")
    p = load(spark, sf_dir, "pages").where("url <> ''").select("page_id", (F.col("page_id") % 50).alias("request"), "url", source.alias("source"))
    up = p.where("not (source = 'api' and request % 3 = 0) and not (source = 'engine' and request >= 20)")
    five = top_per_key(up, ["request", "source"], [F.col("page_id")], 5)
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("source") == name, F.struct("page_id", "url"))))
    lists = five.groupBy("request").agg(of("api").alias("api"), of("engine").alias("engine"), of("feed").alias("feed"))
    found = lists.select("request", F.posexplode(readers.first_source(F.col("api"), F.col("engine"), F.col("feed"))).alias("pos", "r"))
    return found.select("request", (F.col("pos") + 1).alias("pos"), "r.page_id", "r.url")


@query("""
WITH chunks AS (SELECT doc_id AS id, source AS law, doc_id % 7 AS article FROM documents), gold AS (SELECT item_id AS gold_id, 'SRC' || item_id % 5 AS kw, item_id % 7 AS article FROM benchmark)
SELECT gold_id, min(id) AS id FROM gold JOIN chunks ON chunks.article = gold.article AND contains(lower(law), lower(kw)) GROUP BY gold_id
""")
def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law_name"), (F.col("doc_id") % 7).alias("article_number"))
    g = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gold_id"), F.concat(F.lit("SRC"), F.col("item_id") % 5).alias("law_keyword"), (F.col("item_id") % 7).alias("article_number"))
    return evaluation.gold_lookup(c, g)


# ---- logs

LOG_SQL = """
r AS (SELECT user_id::varchar AS user_id, event_id, event_type, row_number() OVER w AS nth, row_number() OVER w + max(us - n) OVER (w ROWS UNBOUNDED PRECEDING) AS us
      FROM (SELECT *, epoch_us(date_trunc('day', ts)) AS us, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
e AS (SELECT user_id, event_id, nth, us, event_id || '|' || event_type || '||' || user_id || '|' || strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 <> 0 THEN '.' || lpad((us % 1000000)::varchar, 6, '0') ELSE '' END || '+00:00' AS payload FROM r)
"""


@query(f"""
WITH RECURSIVE {LOG_SQL},
chain AS (
  SELECT user_id, event_id, nth, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || payload) AS entry_hash FROM e WHERE nth = 1
  UNION ALL SELECT e.user_id, e.event_id, e.nth, c.entry_hash, sha256(c.entry_hash || '|' || e.payload) FROM chain c JOIN e ON e.user_id = c.user_id AND e.nth = c.nth + 1
)
SELECT user_id, event_id, us AS at_us, prev_hash, entry_hash FROM chain JOIN e USING (user_id, event_id)
""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries with all their fields; clocks of one day tick once, so times are made strictly increasing before they are hashed."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_trunc("day", "ts").alias("at"))
    e = e.withColumn("at_us", audit.rising(F.col("at"), "user_id", "event_id"))
    fields = ["event_id", "event_type", F.lit(""), "user_id", audit.utc_text(F.timestamp_micros("at_us"))]
    chain = audit.chain_append(e.select("user_id", "event_id", F.concat_ws("|", *fields).alias("payload")), "user_id", "event_id", "payload")
    times = e.select(F.col("user_id").cast("string").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "at_us")
    return chain.drop("payload").join(times, ["user_id", "event_id"]).select("user_id", "event_id", "at_us", "prev_hash", "entry_hash")


@query("""
SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 200 ELSE 409 END AS status FROM events WHERE event_type IN ('purchase', 'error')
""")
def one_shot_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases execute and errors reject a user's request; only the first decision counts."""
    action = F.when(F.col("event_type") == "purchase", "execute").when(F.col("event_type") == "error", "reject").otherwise("view")
    return audit.decisions(load(spark, sf_dir, "events").withColumn("action", action), "user_id", "event_id", "action").select("event_id", "status")


@query("""
WITH l AS (SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY user_id)
SELECT user_id % 25 AS kind, bool_or(last IN ('signup', 'view')) AS has_running FROM l GROUP BY kind
""")
def running_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of jobs of which one is queued or running, by the last event of each job."""
    last = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    status = F.when(F.col("last") == "signup", "queued").when(F.col("last") == "view", "running").otherwise("done")
    return audit.running_kinds(last.select((F.col("user_id") % 25).alias("kind"), status.alias("status")), "kind", "status")


@query("""
WITH a AS (SELECT event_id, event_type, floor(value) / 50 AS score, ts FROM events WHERE value BETWEEN 0 AND 50)
SELECT event_id AS question, score AS answer_quality, CASE WHEN score < 0.7 THEN 'Skor ' || format('{:.2f}', score) || ' < 0.7 untuk topik ' || event_type END AS gap_description,
       CASE WHEN score < 0.7 THEN 're-research terjadwal' END AS remediation_action, score >= 0.7 AS resolved, CASE WHEN score >= 0.7 THEN epoch_us(ts) END AS resolved_us FROM a
""")
def quiz_gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").where("value between 0 and 50")
    a = e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("question"), F.lit("x").alias("answer"), (F.floor("value") / 50).alias("score"), F.col("ts").cast("timestamp").alias("at"))
    return evaluation.gap_rows(a).select("question", "answer_quality", "gap_description", "remediation_action", "resolved", F.unix_micros("resolved_at").alias("resolved_us"))


@query("""
WITH r AS (SELECT c_nationkey AS region, count(*) AS laws, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS nth FROM customer GROUP BY region)
SELECT count(*) AS regions, sum(laws)::bigint AS laws FROM r WHERE nth > 20
""")
def overflow_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of the regions beyond the twenty that are drawn."""
    r = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("laws"))
    drawn = r.orderBy(F.col("laws").desc(), "c_nationkey").limit(20)
    return r.join(drawn, "c_nationkey", "left_anti").agg(F.count(F.lit(1)).alias("regions"), F.sum("laws").alias("laws"))


# ---- values

@query("""
SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'BUILDING,MACHINERY' ELSE 'BUILDING,MACHINERY,' || c_mktsegment END AS domains,
       'BUILDING,MACHINERY,' || c_mktsegment AS steps, ['red', 'green', 'blue'][c_custkey % 3 + 1] AS colour FROM customer
""")
def merged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults with what is configured, once each in order; lists joined; a colour by index modulo."""
    base, own = F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.array("c_mktsegment")
    colours = F.array(*[F.lit(c) for c in ("red", "green", "blue")])
    return load(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_distinct(F.concat(base, own)), ",").alias("domains"), F.array_join(F.concat(base, own), ",").alias("steps"), X.cyclic(colours, F.col("c_custkey")).alias("colour"))
