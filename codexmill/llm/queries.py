"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import round_trip
from .collocations import collocations
from .common import shared_dir, table
from .decontaminate import find_contamination
from .image_copies import copy_groups, rendered
from .jaccard_join import jaccard_components
from .language_id import held_out, predict, train
from .line_dedup import dedup_lines
from .ppm_score import score
from .secret_scan import ADDED, BASE, find_secrets, listed
from .sharding import shard_by_bytes
from .token_store import read_documents, write_tokens
from .url_filter import Rule, judge_urls
from .vector_codes import vector_codes

RULES = [
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
]


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url; outcomes are the labels of the documents that the pages show (their number is in the path)."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("doc_id"))
    return judge_urls(pages.join(labels, "doc_id", "left"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH lab AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), parsed AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
         try_cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint) AS doc_id
  FROM pages
), sites AS (
  SELECT p.*, l.good, regexp_replace(regexp_replace(host, '(?s)\A.*@', ''), '\.?(:[0-9]*)?\z', '') AS site FROM parsed p LEFT JOIN lab l USING (doc_id)
), seen AS (
  SELECT *, CASE WHEN regexp_matches(site, '\A[0-9]+(\.[0-9]+){3}\z') THEN site WHEN regexp_matches(site, '(^|\.)(ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}\z') THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*\z', 0)
              ELSE regexp_extract(site, '([^.]*\.)?[^.]*\z', 0) END AS domain,
         CASE WHEN regexp_matches(site, '\A[0-9]+(\.[0-9]+){3}\z') THEN '' WHEN regexp_matches(site, '(^|\.)(ac|co|com|edu|go|gob|gouv|gov|mil|ne|net|nom|or|org|sch)\.[a-z]{2}\z') THEN regexp_extract(site, '[^.]*\.[^.]*\z', 0)
              ELSE regexp_extract(site, '[^.]*\z', 0) END AS suffix
  FROM sites
), h AS (
  SELECT site, domain, suffix, count(good)::double AS n, coalesce(sum(good), 0)::double AS s FROM seen GROUP BY ALL
), d AS (
  SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM h GROUP BY ALL
), x AS (
  SELECT suffix, 1 AS everything, sum(n) AS n, sum(s) AS s FROM d GROUP BY ALL
), moments AS (
  SELECT lvl, sum(k - 1) AS btw, sum(sn - k) AS wit, sum(own - ss * ss / sn) AS ssb, sum(ss - own) AS ssw, sum(sn - q / sn) AS n0
  FROM (
    SELECT 'x' AS lvl, count(*) AS k, sum(n) AS sn, sum(s) AS ss, sum(n * n) AS q, sum(s * s / n) AS own FROM x WHERE n > 0 GROUP BY everything
    UNION ALL SELECT 'd', count(*), sum(n), sum(s), sum(n * n), sum(s * s / n) FROM d WHERE n > 0 GROUP BY suffix
    UNION ALL SELECT 'h', count(*), sum(n), sum(s), sum(n * n), sum(s * s / n) FROM h WHERE n > 0 GROUP BY domain
  ) GROUP BY lvl
), rho AS (
  SELECT lvl, btw, wit, CASE WHEN btw > 0 AND wit > 0 AND ssb / btw + (n0 / btw - 1) * ssw / wit > 0
    THEN (ssb / btw - ssw / wit) / (ssb / btw + (n0 / btw - 1) * ssw / wit) ELSE 0 END AS r FROM moments
), strength AS (
  SELECT lvl, CASE WHEN btw = 0 OR wit = 0 THEN 10.0 WHEN r > 0 THEN least(1000.0, greatest(2.0, 1 / r - 1)) ELSE 1000.0 END AS m FROM rho
), m AS (
  SELECT coalesce((SELECT m FROM strength WHERE lvl = 'x'), 10.0) AS mx, coalesce((SELECT m FROM strength WHERE lvl = 'd'), 10.0) AS md,
         coalesce((SELECT m FROM strength WHERE lvl = 'h'), 10.0) AS mh, (SELECT (sum(s) + 1) / (sum(n) + 2) FROM x) AS rate
), xm AS (
  SELECT suffix, (mx * rate + s) / (mx + n) AS mean FROM x, m
), dm AS (
  SELECT d.domain, d.suffix, (md * xm.mean + d.s) / (md + d.n) AS mean FROM d JOIN xm USING (suffix), m
), hm AS (
  SELECT h.site, (mh * dm.mean + h.s) / (mh + h.n) AS mean, mh + h.n AS total FROM h JOIN dm USING (domain, suffix), m
), verdicts AS (
  SELECT site, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) >= 0.5 THEN 'allow' ELSE 'block' END AS v FROM hm
), rules(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), ruled AS (
  SELECT seen.page_id, seen.host, seen.path, seen.site,
         (SELECT max_by(struct_pack(r := rh || rp, v := rules.verdict), length(rh || rp)) FROM rules
          WHERE (seen.host = rh OR ends_with(seen.host, '.' || rh)) AND starts_with(seen.path, rp)) AS hit
  FROM seen
)
SELECT page_id, host, path, hit.r AS rule, coalesce(hit.v, v.v) AS verdict FROM ruled JOIN verdicts v USING (site)
"""


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among the images made of all embeddings."""
    images = rendered(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return copy_groups(images).withColumnRenamed("id", "vec_id")


def op3_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as directly addressable codes and read back."""
    path = f"{shared_dir(spark)}/codexmill/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_documents(spark, path, with_ids=False)


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 7))
    return score(docs, docs.where("not held_out")).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to ids and decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 3-word shingles are similar to 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4))
    model = train(docs.where("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents share with the benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH low AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id::varchar AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), wins AS (
  SELECT DISTINCT item, least(len(ws), 13) AS k, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), docwins AS (
  SELECT rid, k, i, array_to_string(ws[i : i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM low, (SELECT DISTINCT k FROM wins) WHERE len(ws) >= k)
), hits AS (
  SELECT d.rid, d.k, d.i, w.item FROM docwins d JOIN wins w ON w.k = d.k AND w.win = d.win
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM low LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least 10 documents hold."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT rid, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), hot AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), marked AS (
  SELECT l.*, h.key IS NOT NULL AS dropped FROM lines l LEFT JOIN hot h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"), max_words=5, min_count=100, covered_percent=100, top=2000)


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*)::hugeint AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k) GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::hugeint AS n FROM grams WHERE k = 1 GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE k > 1 AND f >= 100
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, l.f AS l, r.f AS r, n, 1000 * c.a * n // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : j], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[j + 1 :], ' ') JOIN total ON total.lang = c.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::bigint AS a, l::bigint AS l, r::bigint AS r, n::bigint AS n, score::bigint AS score
FROM kept QUALIFY rank <= 2000
"""

def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 4 parts of 256 entries, 4 rounds."""
    return vector_codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


OP12_START = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM kept
), parts AS MATERIALIZED (
  SELECT rid, p, q, list_inner_product(q, q) AS qq FROM (SELECT rid, p, v[p * 16 + 1 : p * 16 + 16] AS q FROM numbered, (SELECT unnest(range(4)) AS p))
), c0 AS MATERIALIZED (
  SELECT p, rid - 1 AS e, q AS c, qq AS cc FROM parts WHERE rid <= 256
"""
#: Nearest entries of all parts in round {i}: distance and entry as one number.
OP12_ASSIGN = """), a{i} AS MATERIALIZED (
  SELECT rid, parts.p, min((qq - 2 * list_inner_product(q, c) + cc)::bigint * 256 + e) AS best FROM parts JOIN c{i} USING (p) GROUP BY ALL
"""
OP12_MEANS = """), m{j} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS double) ORDER BY d) AS c
  FROM (SELECT parts.p, best % 256 AS e, d, sum(q[d]::bigint) AS s, count(*) AS n FROM parts JOIN a{i} USING (rid, p), (SELECT unnest(range(1, 17)) AS d) GROUP BY ALL) GROUP BY p, e
), c{j} AS MATERIALIZED (
  SELECT p, e, coalesce(m{j}.c, c{i}.c) AS c, list_inner_product(coalesce(m{j}.c, c{i}.c), coalesce(m{j}.c, c{i}.c)) AS cc FROM c{i} LEFT JOIN m{j} USING (p, e)
"""
OP12_END = """), coded AS (
  SELECT rid, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::bigint AS error FROM a4 GROUP BY rid
), book AS (
  SELECT sha256(string_agg(v::bigint::varchar, ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS d FROM c4)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM coded JOIN numbered USING (rid), book
"""
OP12_SQL = OP12_START + "".join(OP12_ASSIGN.format(i=i) + OP12_MEANS.format(i=i, j=i + 1) for i in range(4)) + OP12_ASSIGN.format(i=4) + OP12_END

def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: three base kinds, and keys and tokens of services."""
    rules = BASE + ADDED
    out = find_secrets(table(spark, sf_dir, "documents"), rules)
    of = lambda n: F.filter("found", lambda r: r["number"] == n)
    base = F.filter("found", lambda r: r["number"] < len(BASE))
    return out.select("doc_id", *[F.size(of(n)).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.sha2(F.encode(listed(base, rules), "UTF-8"), 256).alias("base_sha256"), listed(F.col("found"), rules).alias("spans"))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


OP13_SQL = "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), found AS (" + " UNION ALL ".join(
    f"""
  SELECT rid, {n} AS number, '{r.kind}' AS kind, start, start + size AS stop FROM (
    SELECT rid, unnest(list_transform(range(1, len(sizes) + 1), lambda i: list_sum(gaps[:i]) + coalesce(list_sum(sizes[:i - 1]), 0)))::bigint AS start, unnest(sizes) AS size, unnest(parts) AS part
    FROM (SELECT rid, list_transform(regexp_split_to_array(text, '{_quoted(r.pattern)}'), lambda s: length(s)) AS gaps, list_transform(regexp_extract_all(text, '{_quoted(r.pattern)}'), lambda s: length(s)) AS sizes,
                 list_transform(regexp_extract_all(text, '{_quoted(r.pattern)}', {r.part}), lambda s: length(s)) AS parts FROM d WHERE regexp_matches(text, '{_quoted(r.pattern)}'))
  ) WHERE part >= {r.least}"""
    for n, r in enumerate(BASE + ADDED)
) + """
)
SELECT doc_id, count(*) FILTER (number = 0) AS n_assign, count(*) FILTER (number = 1) AS n_access, count(*) FILTER (number = 2) AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number) FILTER (number IS NOT NULL), '') AS spans
FROM d LEFT JOIN found USING (rid) GROUP BY rid, doc_id
"""

QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_image_copies": op2_image_copies,
    "op3_direct_codes": op3_direct_codes,
    "op4_ppm_score": op4_ppm_score,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_shard_bytes": op6_shard_bytes,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}
ORACLE_SQL = {
    "op1_url_reputation": OP1_SQL,
    "op9_decontaminate": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_secret_scan": OP13_SQL,
}
