"""Text and legal queries, with their SQL. Literal results are worked by hand from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import load
from ..functions import text as X
from ..operators.keyed import top_per_key

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
WITH c AS (SELECT doc_id, unnest(range(0, greatest(ceil(length(text) / 450)::bigint, 0))) AS i, text FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, i, regexp_replace(substr(text, i * 450 + 1, 500), '^\\s+|\\s+$', '', 'g') AS piece FROM c),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS n, piece FROM s WHERE piece <> '')
SELECT doc_id, idx::int AS chunk_index, n::int AS total_chunks, left(sha256('documents|' || doc_id || '|' || idx), 24) AS id, md5(piece) AS piece FROM k
""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", X.chunks(F.col("text")).alias("c"))
    d = d.select("doc_id", F.size("c").alias("total_chunks"), F.posexplode("c").alias("chunk_index", "piece"))
    return d.select("doc_id", "chunk_index", "total_chunks", X.chunk_id(F.lit("documents"), F.col("doc_id").cast("string"), F.col("chunk_index")).alias("id"), F.md5("piece").alias("piece"))


@query("""
WITH p AS (
  SELECT doc_id, text, list_filter(list_transform(range(0, ceil(length(text) / 450)::bigint), lambda i: regexp_replace(substr(text, i * 450 + 1, 500), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS pieces FROM documents WHERE length(text) > 0
), j AS (
  SELECT doc_id, text, list_reduce(pieces, lambda x, y: x || substr(y, list_max(list_filter(range(0, least(200, length(x), length(y)) + 1), lambda k: suffix(x, left(y, k)))) + 1), '') AS again FROM p
)
SELECT doc_id, length(text)::int AS chars, md5(again) AS again, regexp_replace(text, '\\s', '', 'g') = regexp_replace(again, '\\s', '', 'g') AS same FROM j
""")
def rejoin_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all texts joined again, and whether that gives the text but for white space: not where a text repeats itself, or has white space, at a chunk's edge."""
    d = load(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", X.rejoin(X.chunks(F.col("text"))).alias("again"))
    return d.select("doc_id", F.length("text").alias("chars"), F.md5("again").alias("again"), (F.regexp_replace("text", r"\s", "") == F.regexp_replace("again", r"\s", "")).alias("same"))


@query(r"""
WITH t AS (
  SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
    '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<nav\b[^>]*>.*?</nav\s*>', ' ', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', ' ', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', ' ', 'g'), '<[^>]*>', chr(10), 'g') AS x FROM pages
), u AS (
  SELECT page_id, html, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r]*\n[ \t\r\n]*', chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS body FROM t
)
SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')) AS title,
       length(body)::int AS chars, md5(body) AS body, CASE WHEN length(body) >= 200 THEN md5(left(body, 1200)) END AS snippet FROM u
""")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, text and snippet of each page; no snippet for bodies under 200 characters."""
    p = load(spark, sf_dir, "pages").select("page_id", X.page_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("body"))
    return p.select("page_id", "title", F.length("body").alias("chars"), F.md5("body").alias("body"), F.when(F.length("body") >= 200, F.md5(F.substring("body", 1, 1200))).alias("snippet"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS host, url FROM pages)
SELECT page_id, host, host = 'example.net' OR ends_with(host, '.example.net') AS trusted, NOT (contains(host, 'ththr') OR contains(host, 'm.')) AS allowed,
       (CASE WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 2 ELSE 0 END + CASE WHEN ends_with(host, '.org') THEN 1 ELSE 0 END)::int AS preference FROM h
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1
""")
def url_host_and_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, trust and deny lists and preference of each url, at its first occurrence."""
    p = load(spark, sf_dir, "pages").select("page_id", "url", X.host(F.col("url")).alias("host"))
    h, trusted = F.col("host"), X.under(F.col("host"), ["example.net"])
    denied = F.exists(F.array(F.lit("ththr"), F.lit("m.")), lambda d: F.contains(h, d))
    return top_per_key(p, ["url"], [F.col("page_id")]).select("page_id", "host", trusted.alias("trusted"), (~denied).alias("allowed"), (F.when(trusted, 2).otherwise(0) + F.when(F.endswith(h, F.lit(".org")), 1).otherwise(0)).alias("preference"))
