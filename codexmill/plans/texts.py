"""Rules of statutes, decisions, citations, scores and logs over texts that are written from the tables.

A statute, an offence, a decision or an answer is rendered from the rows of a table, and
the library reads it again; the SQL states from the same rows' columns what must be
found. So each query reads whole tables, and its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import load
from ..functions import guard
from ..functions import legal as L
from ..functions import text as X
from ..operators import audit, evaluation, graph
from ..operators import retrieval as R
from ..operators.keyed import spread
from ..streaming import progress
from .retrieval import aliases, mentions
from .stateful import LIMIT_SQL, LIMITS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Orders by short names: ``k`` key, ``c`` customer, ``s`` status, ``p`` whole price, ``y`` year; and ``columns``."""
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey as k", "o_custkey as c", "o_orderstatus as s", "cast(floor(o_totalprice) as bigint) as p", "year(o_orderdate) as y")
    return o.selectExpr("*", *columns)


#: The same orders in SQL.
O = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, floor(o_totalprice)::bigint AS p, year(o_orderdate) AS y FROM orders)"


def roman(n: int) -> str:
    """A small Roman number."""
    out = ""
    for value, sign in ((50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + sign * (n // value), n % value
    return out


NUMERALS = ", ".join(f"'{roman(n)}'" for n in range(1, 61))

# ---- statutes

def statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law for each customer, an article for each of their orders: three articles a chapter, a part in each; every eleventh body is too short to count."""
    o = spread(orders(spark, sf_dir), "c", 50_000).withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("k")).cast("int"))
    o = o.selectExpr(
        "c", "n",
        f"case n % 3 when 1 then concat('BAB ', array({NUMERALS})[int((n - 1) / 3)], '\\nKETENTUAN KELOMPOK ', s, '\\n') when 2 then 'Bagian Kesatu\\nUmum\\n' else '' end as marks",
        "case when k % 11 = 0 then 'pendek' else concat('Pesanan nomor ', k, ' bernilai ', p, ' dan dibayar menurut aturan ini.') end as body",
    )
    piece = F.expr("concat(marks, 'Pasal ', n, '\\n', body, '\\n')")
    law = o.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("t")))), lambda r: r["t"]), "").alias("articles"))
    head = "concat('UNDANG-UNDANG REPUBLIK\\nNOMOR ', c + 1, ' TAHUN ', 1950 + c % 70, '\\nTENTANG\\nPESANAN PELANGGAN ', c, '\\nDENGAN RAHMAT TUHAN\\nMenimbang: ', repeat('pertimbangan ', 18), '\\nSubjek: Uji ', c, '\\nStatus\\n Berlaku\\n'"
    return law.selectExpr("c as doc_id", f"{head}, articles, 'PENJELASAN ATAS\\nPasal 1\\nCukup jelas bagi semua orang yang membaca aturan ini.\\n') as text")


STATUTES_SQL = f"""
{O},
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS n FROM o),
m AS (SELECT *, CASE n % 3 WHEN 1 THEN 'BAB ' || [{NUMERALS}][(n - 1) // 3 + 1] || chr(10) || 'KETENTUAN KELOMPOK ' || s WHEN 2 THEN 'Bagian Kesatu' || chr(10) || 'Umum' ELSE '' END AS marks,
      CASE WHEN k % 11 = 0 THEN 'pendek' ELSE 'Pesanan nomor ' || k || ' bernilai ' || p || ' dan dibayar menurut aturan ini.' END AS body FROM n),
a AS (SELECT c, n, body || CASE WHEN coalesce(lead(marks) OVER w, '') <> '' THEN chr(10) || lead(marks) OVER w ELSE '' END AS body,
      replace(max(CASE WHEN n % 3 = 1 THEN marks END) OVER (PARTITION BY c, (n - 1) // 3), chr(10), ' ') || CASE WHEN n % 3 <> 1 THEN ' · Bagian Kesatu Umum' ELSE '' END AS path
      FROM m WINDOW w AS (PARTITION BY c ORDER BY n))
"""


@query(f"""
WITH {STATUTES_SQL}
SELECT c AS id, 'Pasal ' || n AS article_number, path AS hierarchy, md5('[' || path || ']' || chr(10) || body) AS content FROM a WHERE length(body) >= 30
UNION ALL SELECT DISTINCT c, 'Konsiderans', 'Konsiderans', NULL FROM o
""")
def article_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of all laws with their chapter and part, and the preambles."""
    a = L.articles(statutes(spark, sf_dir))
    return a.select("id", "article_number", "hierarchy", F.when(F.col("article_number") != "Konsiderans", F.md5("content")).alias("content"))


@query(f"WITH {STATUTES_SQL} SELECT c AS id, count(*) FILTER (length(body) >= 30) + 1 AS n FROM a GROUP BY c")
def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each law: the preamble counts, short bodies and the explanation do not."""
    return L.articles(statutes(spark, sf_dir)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {O}
SELECT c AS id, 'UNDANG-UNDANG REPUBLIK NOMOR ' || (c + 1) || ' TAHUN ' || (1950 + c % 70) AS name, (c + 1)::varchar AS number, (1950 + c % 70)::varchar AS year, 'PESANAN PELANGGAN ' || c AS subject,
       ceil(count(*) / 3)::int AS chapters, 'Uji ' || c AS topic, 'Berlaku' AS status, CASE WHEN c % 2 = 0 THEN 'https://x/UU%20Nomor%20' || (c + 1) || '%20Tahun%20' || (1950 + c % 70) || '.pdf' ELSE 'https://x/lain.pdf' END AS link
FROM o GROUP BY c
""")
def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, subject and chapters of each law by its title block, labelled values, and the link that names the law as its page does."""
    d = statutes(spark, sf_dir).withColumnRenamed("doc_id", "id")
    page, own = F.expr("concat('https://x/uu-no-', id + 1, '-tahun-', 1950 + id % 70)"), "concat('https://x/UU%20Nomor%20', id + 1, '%20Tahun%20', 1950 + id % 70, '.pdf')"
    links = F.expr(f"array('https://x/lain.pdf', case when id % 2 = 0 then {own} else 'https://x/UU%20Nomor%20999999%20Tahun%201900.pdf' end)")
    return d.select("id", L.title(F.col("text")).alias("t"), L.labelled(F.col("text"), "Subjek").alias("topic"), L.labelled(F.col("text"), "Status").alias("status"), L.best_link(page, links).alias("link")).select("id", "t.*", "topic", "status", "link")


@query(f"""
WITH {O}
SELECT 'Dok ' || k AS doc, 1 AS pos, 'Awal ' || k AS title, (55 + k % 10)::int AS chars FROM o WHERE k % 10 >= 5 UNION ALL SELECT 'Dok ' || k, 3, 'Bagian ' || c, (60 + c % 5)::int FROM o
""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections at second and third level headings of 60 characters or more."""
    text = "concat('# Dok ', k, '\\npembuka\\n## Awal ', k, '\\n', repeat('a', int(55 + k % 10)), '\\n### Pendek\\nkecil\\n## Bagian ', c, '\\n', repeat('b', int(60 + c % 5)), '\\n') as text"
    return X.markdown_sections(orders(spark, sf_dir, text), "text").select("doc", "pos", "title", F.length("body").alias("chars"))


# ---- offences and decisions

@query(f"""
WITH {O}, f AS (SELECT *, k % 6 AS kind, (c % 3 + 1)::double AS low, (c % 3 + 1 + k % 9)::double AS high FROM o WHERE k % 6 <> 5)
SELECT k AS id, ['Setiap Orang', 'Barang siapa', 'Korporasi', 'subjek tidak eksplisit'][k % 4 + 1] AS pelaku, 'mengambil barang nomor ' || k AS perbuatan, ['dengan sengaja', 'tanpa hak', 'dengan sengaja,tanpa hak', ''][c % 4 + 1] AS sikap_batin,
       CASE WHEN kind IN (0, 2) THEN low END AS penjara_min, CASE WHEN kind IN (0, 1) THEN high WHEN kind = 4 THEN round(high / 12, 2) END AS penjara_maks, kind = 2 AS seumur_hidup, kind = 3 AS pidana_mati,
       CASE WHEN kind = 1 THEN round((c % 11 + 1) / 12, 2) END AS kurungan_maks, CASE WHEN kind IN (0, 3) THEN p::double END AS denda_rp, kind = 2 AS pemberatan, ['dipidana', 'diancam'][k % 2 + 1] AS dipidana_di
FROM f
""")
def offence_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of offences worded from all orders: subjects, states of mind, bounds in years and months, fines; every sixth words none."""
    text = """concat(
      array('Setiap Orang ', 'Barang siapa ', 'Korporasi ', '')[int(k % 4)], array('dengan sengaja ', 'tanpa hak ', 'dengan sengaja dan tanpa hak ', '')[int(c % 4)], 'mengambil barang nomor ', k, ' ', array('dipidana', 'diancam')[int(k % 2)],
      case k % 6
        when 0 then concat(' dengan pidana penjara paling singkat ', c % 3 + 1, ' (x) tahun dan paling lama ', c % 3 + 1 + k % 9, ' (y) tahun dan/atau denda paling banyak Rp', replace(format_number(p, 0), ',', '.'), ',00.')
        when 1 then concat(' dengan pidana penjara paling lama ', c % 3 + 1 + k % 9, ' tahun atau pidana kurungan paling lama ', c % 11 + 1, ' bulan')
        when 2 then concat(' dengan pidana penjara seumur hidup atau pidana penjara paling singkat ', c % 3 + 1, ' tahun, pidana ditambah sepertiga')
        when 3 then concat(' dengan pidana mati atau denda sebesar Rp ', replace(format_number(p, 0), ',', '.'))
        else concat(' dengan pidana penjara paling lama ', c % 3 + 1 + k % 9, ' bulan') end)"""
    rows = spread(orders(spark, sf_dir), "k", 50_000).selectExpr("k as id", f"case when k % 6 = 5 then concat('Ketentuan umum tentang barang nomor ', k) else {text} end as content")
    worded = rows.where(F.col("content").rlike(L.OFFENCE))  # a filter on the elements would be worked out where rows are read
    e = worded.select("id", L.elements(F.col("content")).alias("e")).select("id", "e.*")
    return e.withColumn("sikap_batin", F.array_join("sikap_batin", ","))


@query(f"""
WITH {O}
SELECT k AS decision_id, 'terdakwa ' || k || ' hadir di persidangan dan mengakui perbuatannya;|barang bukti ' || k || ' telah disita secara sah menurut ketentuan Pasal ' || (c % 300 + 1) || ' ayat (1) UU No. 35 Tahun 2009' AS ratio,
       'Pasal ' || (c % 300 + 1) || ' ayat (1) UU No. 35 Tahun 2009' AS pasal_pertimbangan, CASE s WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS terbukti, CASE s WHEN 'F' THEN 'terbukti secara sah dan meyakinkan bersalah melakukan' WHEN 'O' THEN 'membebaskan' END AS status,
       CASE s WHEN 'F' THEN 'Pasal ' || (c % 300 + 1) ELSE '' END AS pasal_amar, CASE s WHEN 'F' THEN (c % 20 + 1) || ' tahun' END AS hukuman, CASE s WHEN 'F' THEN 'menjatuhkan,menyatakan' WHEN 'O' THEN 'membebaskan' ELSE 'menolak' END AS diksi
FROM o
""")
def decision_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, cited articles, outcome and sentence of decisions written from all orders; the ruling of every second one is named by its article number, not its title."""
    o = orders(spark, sf_dir)
    reasons = "concat('Pembuka. Menimbang, bahwa terdakwa ', k, ' hadir di persidangan dan mengakui perbuatannya; Menimbang bahwa pendek; Menimbang, barang bukti ', k, ' telah disita secara sah menurut ketentuan Pasal ', c % 300 + 1, ' ayat (1) UU No. 35 Tahun 2009')"
    ruling = "case s when 'F' then concat('Menyatakan terdakwa terbukti secara sah dan meyakinkan bersalah melakukan uji; Menjatuhkan pidana penjara selama ', c % 20 + 1, ' tahun; melanggar Pasal ', c % 300 + 1) when 'O' then 'Membebaskan terdakwa dari dakwaan' else 'Menolak permohonan' end"
    rows = f"stack(3, 1, 'Kepala', 'x', 'pembuka', 2, 'pertimbangan hukum', 'Amar', {reasons}, 3, if(k % 2 = 0, 'amar putusan', null), 'Amar', {ruling}) as (pos, title, article_number, content)"
    h = L.holdings(o.selectExpr("k as decision_id", rows))
    return h.withColumns({"ratio": F.array_join("ratio", "|")} | {c: F.array_join(c, ",") for c in ("pasal_pertimbangan", "pasal_amar", "diksi")})


# ---- references between laws

@query("""
WITH l AS (SELECT 'UU ' || l_orderkey AS law_name, l_linenumber AS n, l_partkey % 500 + 1 AS a, l_suppkey % 90 + 1 AS b, l_partkey % 40 + 1 AS u FROM lineitem),
r AS (SELECT law_name, n, 'KUHP' AS to_law, a AS t FROM l UNION ALL SELECT law_name, n, 'UU Nomor ' || u, b FROM l UNION ALL SELECT law_name, n, 'KUHP', n FROM l)
SELECT DISTINCT law_name, 'Pasal ' || n AS article_number, to_law, 'Pasal ' || t AS to_article FROM r WHERE t <> n
""")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that leave the article, of articles written from all line items."""
    text = "concat('lihat Pasal ', l_partkey % 500 + 1, ' ayat (1) KUHP dan Pasal ', l_suppkey % 90 + 1, ' UU Nomor ', l_partkey % 40 + 1, ', juga Pasal ', l_linenumber, ' KUHP') as content"
    return L.cross_references(load(spark, sf_dir, "lineitem").selectExpr("concat('UU ', l_orderkey) as law_name", "concat('Pasal ', l_linenumber) as article_number", text))


@query(f"""
WITH {O}, laws AS (SELECT s_suppkey + 1 AS number, s_name AS law_name FROM supplier), r AS (SELECT k, c % 150 + 1 AS n, k % 80 + 2 AS a, c % 60 + 1 AS q, k % 200 + 1 AS m FROM o),
d AS (SELECT k, law_name, a AS art FROM r JOIN laws ON number = n UNION SELECT k, law_name, q FROM r JOIN laws ON number = 1),
b AS (SELECT DISTINCT k, law_name, 1 AS art FROM (SELECT k, n AS number FROM r UNION SELECT k, m FROM r) JOIN laws USING (number))
SELECT 's' || k AS article_number, law_name AS to_law, 'Pasal ' || art AS to_article FROM (SELECT * FROM d UNION SELECT * FROM b WHERE (k, law_name) NOT IN (SELECT k, law_name FROM d))
""")
def decision_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of decisions, in full, by code and of an act alone, resolved by a registry of laws made of the suppliers."""
    text = "concat('Pasal ', k % 80 + 2, ' UU RI Nomor ', c % 150 + 1, ' Tahun ', 1945 + c % 150 + 1, ' dan UU Nomor ', c % 150 + 1, ' Tahun ', 1945 + c % 150 + 1, ', Pasal ', c % 60 + 1, ' KUHP; UU No. 0', k % 200 + 1, ' Tahun ', 1945 + k % 200 + 1) as content"
    laws = load(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey + 1 as string) as number", "cast(1946 + s_suppkey as string) as year", "s_name as law_name")
    return L.decision_citations(orders(spark, sf_dir).selectExpr("concat('s', k) as article_number", text), laws)


@query(f"""
WITH {O} SELECT k AS id, ['revokes', 'amends', 'amended_by', 'amends'][k % 4 + 1] AS relation, 'UU Nomor ' || (c % 99 + 1) || ' Tahun ' || (1950 + c % 70) AS target FROM o
""")
def amend_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What laws written from all orders revoke, amend or are amended by; a document's own number does not count."""
    law = "c % 99 + 1, ' Tahun ', 1950 + c % 70"
    text = f"""case k % 4
      when 0 then concat('Undang-undang ini mencabut UU Nomor 0', {law}, '.')
      when 1 then concat('Mengubah beberapa ketentuan UU Nomor ', {law}, '. Lihat pula UU Nomor 70 Tahun 2001.')
      when 2 then concat('sebagaimana telah diubah dengan UU Nomor ', {law})
      else concat('UU No. ', {law}, ' diubah dengan undang-undang ini. Mencabut. UU Nomor ', k % 97 + 100, ' Tahun 2020 mengatur.') end as text"""
    return L.relations(spread(orders(spark, sf_dir), "k", 50_000).selectExpr("k as id", text, "cast(k % 97 + 100 as string) as own_number", "'2020' as own_year"))


@query(f"""
WITH {O} SELECT k AS id, CASE k % 4 WHEN 1 THEN y::varchar WHEN 2 THEN CASE WHEN y < 1998 THEN y || ',1998' WHEN y > 1998 THEN '1998,' || y ELSE '1998' END ELSE '' END AS years FROM o
""")
def event_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of events in questions written from all orders; those of a law's citation and outside 1945 to 2100 do not count."""
    q = "case k % 4 when 0 then concat('isi UU Nomor 8 Tahun ', y) when 1 then concat('uji pada ', y, ' menurut UU 19/2016') when 2 then concat('dari ', y, ' kembali ke 1998, lalu 1900') end as q"
    return orders(spark, sf_dir).selectExpr("k", q).select(F.col("k").alias("id"), F.array_join(F.transform(L.event_years(F.col("q")), lambda y: y.cast("string")), ",").alias("years"))


@query("""
WITH l AS (SELECT 'UU ' || o_custkey AS name, 'UU ' || o_orderkey % 1500 AS other, o_orderstatus AS s FROM orders),
e AS (SELECT DISTINCT CASE s WHEN 'P' THEN other ELSE name END AS src, CASE s WHEN 'F' THEN 'REVOKES' ELSE 'AMENDS' END AS rel, CASE s WHEN 'P' THEN name ELSE other END AS dst FROM l)
SELECT 'edge' AS kind, src, rel, dst FROM e UNION ALL SELECT 'vertex', id, NULL, NULL FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)
""")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws of all customers with those they revoke, amend and are amended by, as edges and vertices."""
    of = lambda s: F.collect_list(F.when(F.col("s") == s, F.concat(F.lit("UU "), (F.col("k") % 1500).cast("string"))))
    laws = orders(spark, sf_dir).groupBy(F.concat(F.lit("UU "), "c").alias("name")).agg(of("F").alias("revokes"), of("O").alias("amends"), of("P").alias("amended_by"))
    e, v = graph.document_relations(laws)
    none = F.lit(None).cast("string")
    return e.select(F.lit("edge").alias("kind"), "src", "rel", "dst").unionByName(v.select(F.lit("vertex").alias("kind"), F.col("id").alias("src"), none.alias("rel"), none.alias("dst")))


@query(f"WITH {O} SELECT DISTINCT 'UU ' || k % 1500 AS src, 'SUPERIOR_TO' AS rel, 'UU ' || c AS dst FROM o WHERE s <> 'P' AND k % 1500 <> c")
def hierarchy_superior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws cited by laws stand above them; citations by decisions and of oneself do not count."""
    cites = orders(spark, sf_dir).selectExpr("if(s = 'P', concat('Putusan ', k), concat('UU ', c)) as src", "'CITES' as rel", "concat('UU ', k % 1500) as dst")
    return graph.superior(cites, lambda c: c.startswith("Putusan"))


@query(f"""
WITH {O}, v AS (SELECT 'UU ' || c_custkey AS id FROM customer WHERE c_acctbal > 0), e AS (SELECT DISTINCT 'UU ' || c AS src, 'UU ' || k % 3000 AS dst FROM o WHERE 'UU ' || c IN (SELECT id FROM v))
SELECT 'edge' AS kind, src, dst FROM e UNION ALL SELECT 'vertex', id, NULL FROM (SELECT id FROM v UNION SELECT dst FROM e)
""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of known sources; a missing target becomes a vertex."""
    known = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("UU "), "c_custkey").alias("id"))
    e, v = graph.merge_edges(orders(spark, sf_dir).selectExpr("concat('UU ', c) as src", "'CITES' as rel", "concat('UU ', k % 3000) as dst"), known, True)
    return e.select(F.lit("edge").alias("kind"), "src", "dst").unionByName(v.select(F.lit("vertex").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")))


# ---- subjects, candidates, nodes

@query("""
WITH p AS (SELECT p_partkey AS id, list_concat(string_split(lower(p_name), ' '), [lower(p_type)]) AS words, CASE WHEN p_partkey % 3 = 0 THEN [string_split(lower(p_name), ' ')[1]] ELSE [] END AS must,
           lower(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' ' || p_type WHEN 2 THEN string_split(p_name, ' ')[2] END) AS probe FROM part)
SELECT id, coalesce(len(list_filter(words, lambda w: contains(probe, w))) >= greatest(1, ceil(len(words) * 0.6)) AND len(list_filter(must, lambda w: NOT contains(probe, w))) = 0, FALSE) AS matches FROM p
""")
def subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's words are found in a subject that is its name, its name and type, its last word or nothing."""
    p = load(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat(split(lower(p_name), ' '), array(lower(p_type))) as words", "if(p_partkey % 3 = 0, array(split(lower(p_name), ' ')[0]), cast(array() as array<string>)) as must", "case p_partkey % 4 when 0 then upper(p_name) when 1 then concat(p_name, ' ', p_type) when 2 then split(p_name, ' ')[1] end as subject")
    return p.select("id", L.subject_match(F.col("words"), F.col("must"), F.col("subject")).alias("matches"))


@query("""
WITH c AS (SELECT c_custkey AS id, c_custkey % 9 AS n, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 400)::varchar END AS number, (2000 + c_custkey % 20)::varchar AS year, c_acctbal > 0 AS subject, ['Berlaku', NULL, 'Tidak Berlaku / Dicabut'][c_nationkey % 3 + 1] AS status, c_mktsegment AS m FROM customer),
j AS (SELECT *, row_number() OVER (PARTITION BY number, year ORDER BY id) AS nth, (number, year) IN (SELECT (s_suppkey::varchar, (2000 + s_suppkey % 20)::varchar) FROM supplier) AS known FROM c)
SELECT id, CASE WHEN n < 5 THEN 'too_few_articles' WHEN number IS NULL THEN 'identity' WHEN NOT subject THEN 'subject' WHEN status LIKE '%Dicabut' THEN 'obsolete' WHEN nth > 1 THEN 'duplicate' WHEN known THEN 'registered' END AS reject_reason,
       CASE m WHEN 'BUILDING' THEN 'formil' WHEN 'MACHINERY' THEN 'materiil' ELSE 'regulasi' END AS category FROM j
""")
def verify_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates made of all customers pass checks in order; the first of an identity wins; identities of suppliers are known."""
    c = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "cast(c_custkey % 9 as int) as n_articles", "if(c_custkey % 7 = 0, null, lpad(c_custkey % 400, 5, '0')) as number", "cast(2000 + c_custkey % 20 as string) as year", "c_acctbal > 0 as subject",
        "array('Berlaku', null, 'Tidak Berlaku / Dicabut')[c_nationkey % 3] as status", "case c_mktsegment when 'BUILDING' then 'Hukum Acara' when 'MACHINERY' then 'UU Narkotika' else 'UU Bangunan' end as name",
    )
    known = load(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey as string) as number", "cast(2000 + s_suppkey % 20 as string) as year").distinct()
    c = L.funnel(c, known)
    return c.select("id", "reject_reason", L.category(F.col("name")).alias("category"))


def words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z]{{5,}}'), lambda w: w NOT IN ({', '.join(repr(w) for w in L.TOPIC_STOPS)}))"


def covers_sql(words: str) -> str:
    return f"(len({words}) > 0 AND len(list_filter({words}, lambda w: contains(probe, w))) >= greatest(1, ceil(len({words}) * 0.6)))"


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_name, p_type, lower(p_type) || '/' || string_split(p_name, ' ')[2] AS topic, CASE WHEN p_partkey % 3 = 0 THEN 'Undang-Undang tentang ' || p_name || ' ' || p_type END AS canonical, string_split(p_name, ' ')[1] AS must,
           coalesce(nullif(lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '' WHEN 2 THEN p_name || ' ' || p_type END), ''), CASE WHEN p_partkey % 2 = 1 THEN lower(p_type) END, lower(p_brand)) AS probe FROM part),
w AS (SELECT *, {words_sql("canonical")} AS cw, {words_sql("string_split(topic, '/')[1]")} AS t1, {words_sql("string_split(topic, '/')[2]")} AS t2, {words_sql("topic")} AS tw FROM p)
SELECT id, CASE WHEN canonical IS NOT NULL THEN {covers_sql("cw")} AND contains(probe, must) ELSE {covers_sql("t1")} OR {covers_sql("t2")} OR {covers_sql("tw")} END AS matches FROM w
""")
def node_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document is about a node, both made of all parts: canonical nodes by name and own word, others by any alternative of their topic."""
    r = load(spark, sf_dir, "part").selectExpr(
        "p_partkey as id", "concat(lower(p_type), '/', split(p_name, ' ')[1]) as topic", "if(p_partkey % 3 = 0, concat('Undang-Undang tentang ', p_name, ' ', p_type), null) as canonical", "array(split(p_name, ' ')[0]) as must", "'x' as title",
        "case p_partkey % 4 when 0 then p_name when 1 then '' when 2 then concat(p_name, ' ', p_type) end as subject", "if(p_partkey % 2 = 1, p_type, null) as source", "p_brand as name",
    )
    return r.select("id", L.node_match(*[F.col(c) for c in r.columns[1:]]).alias("matches"))


@query("""
WITH p AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN ' Pengujian ' || p_name WHEN 1 THEN p_name END AS tail, ['KUHAP2025', 'PUTUSAN1', 'KPK', 'ITE', 'MILITER'][p_partkey % 5 + 1] AS code FROM part)
SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(tail, '')), '[a-z]{6,}'), lambda w: w NOT IN (""" + ", ".join(repr(w) for w in L.SUBJECT_STOPS) + """)))), ','), '') AS words,
       CASE code WHEN 'PUTUSAN1' THEN 'yurisprudensi' WHEN 'KPK' THEN 'regulasi' WHEN 'ITE' THEN 'materiil' ELSE 'formil' END AS category FROM p
""")
def law_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a law's subject, after its last ``tentang``, and its category by code, of laws made of all parts."""
    r = load(spark, sf_dir, "part").selectExpr("p_partkey as id", "case p_partkey % 3 when 0 then concat('Peraturan tentang ', p_type, ' tentang Pengujian ', p_name) when 1 then p_name end as name", "array('KUHAP2025', 'PUTUSAN1', 'KPK', 'ITE', 'MILITER')[int(p_partkey % 5)] as code")
    return r.select("id", F.array_join(F.array_sort(L.subject_words(F.col("name"))), ",").alias("words"), L.code_category(F.col("code")).alias("category"))


@query("""
WITH e AS (SELECT DISTINCT s_nationkey AS node, s_suppkey % 50 AS number FROM supplier), r AS (SELECT c_nationkey AS node, c_custkey % 50 AS number, c_acctbal > 5000 AS recent FROM customer WHERE c_nationkey % 3 <> 0)
SELECT n_name AS node, CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN EXISTS (SELECT 1 FROM r JOIN e USING (node, number) WHERE r.node = n_nationkey AND recent) THEN 1.0 WHEN EXISTS (SELECT 1 FROM r WHERE r.node = n_nationkey) THEN 0.3 ELSE 0.0 END
       ELSE CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.node = n_nationkey) THEN 0.8 ELSE 0.0 END END::double AS score FROM nation
""")
def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of nations as nodes: suppliers are the identities asked for, customers the documents there are."""
    n = load(spark, sf_dir, "nation")
    named = lambda rows, key, *c: rows.join(n.select(F.col("n_nationkey").alias(key), F.col("n_name").alias("node")), key).select("node", *c)
    expected = named(load(spark, sf_dir, "supplier").selectExpr("s_nationkey", "cast(s_suppkey % 50 as string) as number", "'2020' as year"), "s_nationkey", "number", "year")
    registry = named(load(spark, sf_dir, "customer").where("c_nationkey % 3 <> 0").selectExpr("c_nationkey", "cast(c_custkey % 50 as string) as number", "if(c_acctbal > 5000, '2020', '1999') as year"), "c_nationkey", "number", "year")
    return evaluation.node_scores(n.selectExpr("n_name as node", "n_nationkey % 2 = 0 as canonical"), expected, registry)


# ---- answers and their citations

@query(f"""
WITH {O}, parts AS (SELECT p_partkey AS part, p_name, p_type FROM part),
r AS (SELECT k, y, 1990 + c % 20 AS law_year, 1995 + k % 10 AS event, c % 50 + 1 AS a, c % 50 + 1 + CASE WHEN k % 5 = 0 THEN 0 ELSE 100 END AS b, p_name, lower(CASE WHEN k % 3 = 0 THEN 'lain' ELSE p_name || ' ' || p_type END) AS body FROM o JOIN parts ON part = k % 200),
w AS (SELECT *, list_distinct(list_concat(['mengatur', 'barang'], regexp_extract_all(p_name, '[a-z]{{5,}}'))) AS ws FROM r)
SELECT k AS id, CASE WHEN a = b THEN 1 ELSE 2 END::bigint AS cited, 1::bigint AS verified, CASE WHEN a = b THEN '' ELSE 'Pasal ' || b END AS unverified,
       CASE WHEN a = b OR len(list_filter(ws, lambda w: contains(body, w))) / len(ws) < 0.34 THEN 'Pasal ' || a ELSE '' END AS low_fidelity, CASE WHEN law_year > event THEN 'Pasal ' || a || ' (UU ' || law_year || ' > ' || event || ')' ELSE '' END AS anachronisms
FROM w
""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of answers written from all orders, against sources of which every third says something else."""
    o = orders(spark, sf_dir).withColumn("part", F.col("k") % 200).join(load(spark, sf_dir, "part").selectExpr("p_partkey as part", "p_name", "p_type"), "part")
    answers = o.selectExpr("k as id", "concat('kejadian ', 1995 + k % 10) as query", "concat('Pasal 00', c % 50 + 1, ' mengatur ', p_name, ' barang. Juga Pasal ', c % 50 + 1 + if(k % 5 = 0, 0, 100), ' berlaku.') as summary")
    sources = o.selectExpr("k as id", "concat('UU Nomor 1 Tahun ', 1990 + c % 20) as law_name", "concat('Pasal ', c % 50 + 1) as article_number", "if(k % 3 = 0, 'lain', concat(p_name, ' ', p_type)) as content")
    return L.citation_audit(answers, sources)


@query(f"""
WITH {O}, q AS (SELECT s_suppkey AS query_id, s_suppkey % 4 AS kind, s_suppkey % 50 + 1 AS n, s_suppkey % 30 + 1 AS art FROM supplier), a AS (SELECT k, c % 60 + 1 AS n, k % 40 + 1 AS art FROM o),
law AS (SELECT query_id, k FROM q JOIN a ON a.n = CASE WHEN kind = 1 THEN 35 ELSE q.n END WHERE kind <> 3), art AS (SELECT query_id, k FROM q JOIN a ON a.art = q.art WHERE kind IN (0, 2))
SELECT coalesce(law.query_id, art.query_id) AS query_id, coalesce(law.k, art.k) AS id, round(CASE WHEN law.k IS NOT NULL THEN 0.04 ELSE 0 END + CASE WHEN art.k IS NOT NULL THEN CASE WHEN law.k IS NOT NULL THEN 0.04 ELSE 0.01 END ELSE 0 END, 4)::double AS boost
FROM law FULL JOIN art ON art.query_id = law.query_id AND art.k = law.k
""")
def mention_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of articles made of all orders for questions made of all suppliers: by number and article, by a common name, by a short form, or none."""
    q = load(spark, sf_dir, "supplier").selectExpr("s_suppkey as query_id", "case s_suppkey % 4 when 0 then concat('apa isi Pasal ', s_suppkey % 30 + 1, ' UU Nomor ', s_suppkey % 50 + 1, ' Tahun ', 1975 + s_suppkey % 50) when 1 then 'aturan NARKOTIKA di rumah' when 2 then concat('lihat uu ', s_suppkey % 50 + 1, '/', 1975 + s_suppkey % 50, ' dan pasal ', s_suppkey % 30 + 1) else 'cuaca hari ini' end as query")
    c = orders(spark, sf_dir).selectExpr("k as id", "concat('UU Nomor ', c % 60 + 1, ' Tahun ', 1975 + c % 60) as law_name", "concat('Pasal ', k % 40 + 1) as article_number")
    return mentions(q, c, aliases(spark))


@query("""
WITH c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || ' putusan MA' WHEN 1 THEN text || ' doktrin  putusan' WHEN 2 THEN text END AS q FROM conversations)
SELECT conv_id, turn, coalesce(regexp_matches(lower(q), 'putusan|yurisprudensi|preseden|preceden|jurisprudensi|fatwa|penetapan'), FALSE) AS asks FROM c
""")
def case_law_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of all conversations ask for case law; half of them are made to."""
    q = "case conv_id % 4 when 0 then concat(text, ' putusan MA') when 1 then concat(text, ' doktrin  putusan') when 2 then text end"
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", R.asks_case_law(F.expr(q)).alias("asks"))


@query("""
WITH g AS (SELECT s_suppkey AS q, s_suppkey % 20 + 1 AS n, 2000 + s_suppkey % 10 AS y, s_suppkey % 5 + 1 AS a FROM supplier),
r AS (SELECT o_custkey % 100 AS q, o_custkey % 20 + 1 AS n, 2000 + o_custkey % 10 AS y, o_orderkey % 7 AS a, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS rank FROM orders),
h AS (SELECT g.q, min(rank) AS hit FROM g LEFT JOIN r ON r.q = g.q AND r.n = g.n AND r.y = g.y AND r.a = g.a GROUP BY g.q),
c AS (SELECT h.*, (n, y) IN (SELECT (c_custkey % 30 + 1, 2000 + c_custkey % 7) FROM customer WHERE c_acctbal > 0) AS covered FROM h JOIN g USING (q))
SELECT count(*) AS n, round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END), 4)::double AS hit_rate, round(avg(CASE WHEN hit <= 10 THEN 1.0 / hit ELSE 0.0 END), 4)::double AS mrr,
       round(avg(CASE WHEN hit <= 10 THEN 1.0 ELSE 0.0 END) FILTER (covered), 4)::double AS covered_hit_rate, round(avg(CASE WHEN covered THEN 1.0 ELSE 0.0 END), 4)::double AS coverage FROM c
""")
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate, MRR and coverage of gold questions made of all suppliers, half of them named in the question only, over results made of all orders."""
    g = load(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as question_id", "concat('apa isi Nomor ', s_suppkey % 20 + 1, ' Tahun ', 2000 + s_suppkey % 10, ', yaitu Pasal 0', s_suppkey % 5 + 1, 'B?') as question",
        *[f"if(s_suppkey % 2 = 0, {value}, null) as {name}" for name, value in (("law_number", "concat('00', s_suppkey % 20 + 1)"), ("law_year", "cast(2000 + s_suppkey % 10 as string)"), ("pasal", "cast(s_suppkey % 5 + 1 as string)"))],
    )
    o = orders(spark, sf_dir).withColumn("q", F.col("c") % 100).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("k")))
    results = o.selectExpr("q as question_id", "rank", "concat('UU Nomor ', c % 20 + 1, ' Tahun ', 2000 + c % 10) as law_name", "concat('Pasal 0', k % 7) as article_number")
    registry = load(spark, sf_dir, "customer").where("c_acctbal > 0").selectExpr("lpad(c_custkey % 30 + 1, 4, '0') as number", "cast(2000 + c_custkey % 7 as string) as year")
    return evaluation.metrics(evaluation.first_hits(results, evaluation.gold_keys(g)), registry, 10)


@query(f"""
WITH {O}, r AS (SELECT k AS id, k % 4 <> 0 AS ok_p, CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'b'] END AS want, CASE WHEN k % 13 <> 0 THEN CASE c % 3 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE ['a', 'c'] END END AS got, k % 3 <> 1 AS ok_m, p % 1500 >= 1000 AS ok_d, k % 13 = 0 AS none FROM o),
x AS (SELECT *, len(list_intersect(want, coalesce(got, []))) AS n FROM r), y AS (SELECT *, CASE WHEN len(want) = 0 THEN 1.0 ELSE n / len(want) END::double AS recall FROM x)
SELECT id, ok_p AND NOT none AS pelaku, recall, CASE WHEN none THEN 0.0 ELSE n / greatest(len(got), 1) END::double AS prec, ok_m AND NOT none AS penjara, ok_d AND NOT none AS denda,
       CASE WHEN none THEN 'no_elements' WHEN ok_p AND recall >= 1 AND ok_m AND ok_d THEN 'ok' ELSE concat_ws(',', CASE WHEN NOT ok_p THEN 'pelaku' END, CASE WHEN recall < 1 THEN 'sikap' END, CASE WHEN NOT ok_m THEN 'penjara' END, CASE WHEN NOT ok_d THEN 'denda' END) END AS status FROM y
""")
def element_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of elements extracted from all orders; every thirteenth has none."""
    got = lambda value: f"if(k % 13 = 0, null, {value})"
    rows = orders(spark, sf_dir).selectExpr(
        "k as id", "if(k % 4 = 0, 'badan', 'orang') as want_pelaku", "slice(array('a', 'b'), 1, int(k % 3)) as want_sikap", "double(c % 10) as want_max", "double(1000) as want_denda",
        f"{got(chr(39) + 'setiap orang' + chr(39))} as pelaku", f"{got('slice(array(' + chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'c' + chr(39) + '), 1, int(c % 3))')} as sikap", f"{got('double(c % 10 + if(k % 3 = 1, 1, 0))')} as got_max", f"{got('double(p % 1500)')} as got_denda",
    )
    return evaluation.element_scores(rows)


@query("""
WITH s AS (SELECT l_orderkey AS id, list(l_quantity / 50) FILTER (l_returnflag = 'R') AS scores, count(*) AS cited, count(*) FILTER (l_linestatus = 'F') AS verified FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN coalesce(len(scores), 0) = 0 THEN 'no_evidence' WHEN list_max(scores) < 0.55 THEN 'weak_evidence' WHEN cited >= 2 AND verified = 0 THEN 'ungrounded_citations' END AS abstained FROM s
""")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers made of all orders abstain: returned items are their articles, items that were filled are verified."""
    a = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_quantity") / 50)).alias("scores"), F.count(F.lit(1)).alias("cited"), F.count_if(F.col("l_linestatus") == "F").alias("verified"))
    return a.select("id", evaluation.abstention(F.col("scores"), F.col("cited"), F.col("verified")).alias("abstained"))


@query("""
WITH e AS (SELECT user_id AS node, event_id % 11 / 10 AS score FROM events)
SELECT node, count(*) AS n, round(avg(least(score, 1.0)), 3) AS mean, count(*) FILTER (score < 0.7) AS gaps, CASE WHEN round(avg(least(score, 1.0)), 3) >= 0.7 THEN 'completed' ELSE 'gap_detected' END AS status FROM e GROUP BY node
""")
def self_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiz scores of all users, read from free text."""
    return evaluation.self_evaluation(load(spark, sf_dir, "events").selectExpr("user_id as node", "concat('skor: ', event_id % 11 div 10, '.', event_id % 11 % 10, ' dari 1') as answer"))


@query("SELECT page_id AS id, nullif(string_split(url, '/')[3], '') AS source_domain, CASE WHEN page_id % 3 = 0 THEN 1.0 ELSE 0.5 END::double AS verification_score, least(255, page_id % 400)::int AS name_chars FROM pages")
def registry_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of all pages: third slash token of the url, score by verification, name cut at 255."""
    r = load(spark, sf_dir, "pages").selectExpr("page_id", "url", "case page_id % 3 when 0 then true when 1 then false end as verified", "repeat('n', int(page_id % 400)) as law_name")
    return r.select(F.col("page_id").alias("id"), F.nullif(F.get(F.split("url", "/"), F.lit(2)), F.lit("")).alias("source_domain"), F.when(F.col("verified"), 1.0).otherwise(0.5).alias("verification_score"), F.length(F.substring("law_name", 1, 255)).alias("name_chars"))


@query(f"WITH {O} SELECT k AS id, CASE WHEN c % 5 BETWEEN 1 AND 3 AND k % 7 <> 0 THEN round(p / (c % 5) * (4 - c % 5))::bigint END AS eta_s FROM o")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left of jobs made of all orders, at the pace so far; null unless 0 < done < total."""
    return orders(spark, sf_dir).select(F.col("k").alias("id"), progress.eta(F.col("p").cast("double"), F.when(F.col("k") % 7 != 0, F.col("c") % 5), F.lit(4)).alias("eta_s"))


# ---- values

@query("""
SELECT c_custkey AS id, c_custkey::varchar AS zeros, c_name || ' ' || c_mktsegment AS collapsed, regexp_replace(regexp_replace(lower(c_name || ', ' || c_mktsegment || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'shop' || c_custkey % 9 || '.org' AS host,
       'a/b ' || c_custkey AS decoded, c_mktsegment || '.|ya;|ok!' AS sents, least(1.0, c_custkey % 20 / 10)::double AS clamped, to_base64(encode(c_mktsegment)) AS b64, c_custkey || '.txt' AS base, ceil(length(c_mktsegment) / 4)::bigint AS tok,
       CASE WHEN c_custkey % 2 = 0 THEN 'uu nomor ' || c_custkey ELSE 'abc' END AS hint, CASE WHEN c_custkey % 3 <> 0 THEN '{"k": ' || c_custkey || '}' END AS json FROM customer
""")
def scalar_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a scalar function, over texts written from all customers."""
    r = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "c_mktsegment as m", "lpad(c_custkey, 9, '0') as n", "concat('  ', c_name, ' \\t\\n ', c_mktsegment, ' ') as s", "concat(c_name, ', ', c_mktsegment, '!') as t", "concat('https://www.Shop', c_custkey % 9, '.org:80/p') as url", "concat('a%2Fb%20', c_custkey) as enc",
        "concat(c_mktsegment, '. ya; ok!') as sents", "concat('nilai ', c_custkey % 20 div 10, '.', c_custkey % 20 % 10) as score", "concat('a/b/', c_custkey, '.txt') as path", "if(c_custkey % 2 = 0, concat('isi UU Nomor ', c_custkey, ' itu'), 'abc') as q", "if(c_custkey % 3 = 0, 'none', concat('x {\"k\": ', c_custkey, '} y')) as j",
    )
    return r.select(
        "id",
        F.when(F.col("id") == 0, "0").otherwise(X.no_zeros(F.col("n"))).alias("zeros"),
        X.collapse(F.col("s")).alias("collapsed"),
        X.slug(F.col("t")).alias("slug"),
        X.host(F.col("url")).alias("host"),
        F.try_url_decode("enc").alias("decoded"),
        F.array_join(X.sentences(F.col("sents")), "|").alias("sents"),
        evaluation.quiz_score(F.col("score")).alias("clamped"),
        F.base64(F.col("m").cast("binary")).alias("b64"),
        F.element_at(F.split("path", "/"), -1).alias("base"),
        F.ceil(F.length("m") / 4).alias("tok"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract("q", r"(?i)uu nomor \d+", 0)), F.lit("")), F.substring("q", 1, 60)).alias("hint"),
        F.nullif(F.regexp_extract("j", r"(?s)\{.*\}", 0), F.lit("")).alias("json"),
    )


@query("SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN '2031-02-03T04:05:0' || page_id % 10 WHEN 1 THEN '2030-01-1' || page_id % 10 END AS published FROM pages")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of publication of all pages; two of three are given a tag, of another kind each."""
    html = """case page_id % 3 when 0 then concat('<meta property="article:published_time" content="2031-02-03T04:05:0', page_id % 10, '"><meta name="publishdate" content="x">', html)
      when 1 then concat('<META name="publishdate" content="2030-01-1', page_id % 10, '">', html) else html end"""
    return load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), X.page_date(F.expr(html)).alias("published"))


@query("""
SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN event_type || ',v' END AS categories, CASE event_id % 4 WHEN 0 THEN 'x = ' || user_id WHEN 1 THEN 'cut' || chr(10) || user_id END AS code FROM events
""")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and objects in free text written from all events: whole, cut off, or none."""
    r = load(spark, sf_dir, "events").selectExpr(
        "event_id as id", """case event_id % 3 when 0 then concat('so [{"category": "', event_type, '"}, {"x": 1}, {"category": "v"}] ') when 1 then '[1, 2' else 'none' end as a""",
        r"""case event_id % 4 when 0 then concat('out {"code": "x = ', user_id, '", "n": 2} end') when 1 then concat('{"n": 1, "code": "cut\\n', user_id) when 2 then 'none' end as o""",
    )
    return r.select("id", F.array_join(F.transform(X.json_objects(F.col("a"), "category string", "category"), lambda o: o["category"]), ",").alias("categories"), X.json_field(F.col("o"), "code").alias("code"))


@query(f"WITH {O} SELECT k AS id, k % 6 NOT IN (3, 4) AS valid FROM o")
def uuid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of UUIDs written from all orders; short ones and nulls are none, new ones are."""
    h = "md5(cast(k as string))"
    dashed = f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21))"
    v = f"case k % 6 when 0 then {dashed} when 1 then concat('{{', {h}, '}}') when 2 then concat('urn:uuid:', upper({dashed})) when 3 then substr({h}, 2) when 4 then null else uuid() end"
    return orders(spark, sf_dir).select(F.col("k").alias("id"), X.valid_uuid(F.expr(v)).alias("valid"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN ['Konsiderans', 'Penutup'][l_suppkey % 2 + 1] ELSE (l_linenumber * 7 % 13) || ['', 'A', 'B'][l_partkey % 3 + 1] END AS article FROM lineitem)
SELECT l_orderkey, l_linenumber, article, row_number() OVER (PARTITION BY l_orderkey ORDER BY TRY_CAST(regexp_extract(article, '^[0-9]+') AS int) IS NULL, TRY_CAST(regexp_extract(article, '^[0-9]+') AS int), article, l_linenumber) AS pos FROM l
""")
def natural_sort_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article numbers of all orders' items by their number, then text; those without a number last."""
    a = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "if(l_partkey % 5 = 0, array('Konsiderans', 'Penutup')[int(l_suppkey % 2)], concat(l_linenumber * 7 % 13, array('', 'A', 'B')[int(l_partkey % 3)])) as article")
    return a.withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*X.natural(F.col("article")), "l_linenumber")))


CODES = (
    "'import csv, json\\nfrom re import sub\\nprint(1)'", "'import os, numpy\\nos.environ[0]\\neval(1)'", "concat('open(\\'', k, '.txt\\', \\'w\\')')", "'  '", "'from subprocess import run\\nimport yaml\\np.write_text(1)\\nx = \\'../b\\''",
    "'def _sha256(f): pass\\nopen(\\'/etc/x\\')  # sha256'", "null", "'def f(:'", "'import sys\\nsys.exit(1)'", "concat('m = ', k, '\\nopen(\\'x.txt\\', m)')",
)
CODE_SQL = ["", "attribute:os.environ,call:eval,environment,import:os,module:os", "mode:w,write_mode", "empty", "import:subprocess,method:write_text,module:subprocess,module:yaml,path_traversal", "system_path", "empty", "syntax", "attribute:sys.exit,import:sys,module:sys", "mode:?"]


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).selectExpr("k as id", f"array({', '.join(CODES)})[int(k % {len(CODES)})] as code", "if(c % 3 = 0, 'baca bukti', 'hitung') as description")


@query(f"WITH {O}, v AS (SELECT k AS id, k % 10 AS kind, {CODE_SQL!r}[k % 10 + 1] AS violations FROM o) SELECT id, violations, violations = '' AS allowed, kind IN (2, 9) AS unhashed FROM v")
def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static scan of pieces of code written from all orders."""
    c = codes(spark, sf_dir).withColumn("v", guard.violations(F.col("code")))
    return c.select("id", F.array_join("v", ",").alias("violations"), (F.size("v") == 0).alias("allowed"), guard.unhashed_open(F.col("code")).alias("unhashed"))


@query(f"WITH {O} SELECT k AS id, c % 3 = 0 AS needs, c % 3 = 0 AND k % 10 NOT IN (5, 6) AS injected FROM o")
def custody_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that touches evidence by its description is led by the scaffold, unless it has one, or is null."""
    c = codes(spark, sf_dir)
    code, description = F.col("code"), F.col("description")
    led = guard.with_custody(code, description, F.lit("# custody"))
    return c.select("id", guard.needs_custody(code, description).alias("needs"), F.coalesce(F.startswith(led, F.lit("# custody")), F.lit(False)).alias("injected"))


@query(LIMIT_SQL.replace("FROM events)", "FROM events WHERE event_type <> 'view')") + "SELECT id, rule, ok AS admitted, wait::int AS retry_after FROM s UNION ALL SELECT event_id, NULL, TRUE, NULL FROM events WHERE event_type = 'view'")
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissions of all events by the rules for posts; views are gets, which no rule holds."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("ip"), F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"), F.col("event_type").alias("path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return audit.rate_limit(e, spark.sql(LIMITS)).select("id", "rule", "admitted", "retry_after")


@query("""
WITH t AS (SELECT * FROM (VALUES ('free', 2048, 512), ('level1', 8192, 2048), ('level2', 16384, 4096)) t(tier, ctx, predict)),
a AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'free' WHEN 'MACHINERY' THEN 'level1' WHEN 'HOUSEHOLD' THEN 'level2' ELSE 'gold' END AS tier, 2048 * (1 + c_custkey % 5) AS hc, 512 * (1 + c_custkey % 6) AS hp, c_custkey % 11 AS score FROM customer)
SELECT id, tier, least(hc, coalesce(ctx, 2048))::int AS num_ctx, least(hp, coalesce(predict, 512))::int AS num_predict, CASE WHEN score < 3 THEN 'starter' WHEN score <= 7 THEN 'growth' ELSE 'full' END AS feature FROM a LEFT JOIN t USING (tier)
""")
def tier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of a tier's and the hardware's budget for all customers; an unknown tier is free. Features by score thresholds."""
    # Context and generation lengths of the tiers.
    tiers = {"free": (2048, 512), "level1": (8192, 2048), "level2": (16384, 4096)}
    asked = load(spark, sf_dir, "customer").selectExpr("c_custkey as id", "case c_mktsegment when 'BUILDING' then 'free' when 'MACHINERY' then 'level1' when 'HOUSEHOLD' then 'level2' else 'gold' end as tier", "int(2048 * (1 + c_custkey % 5)) as hw_ctx", "int(512 * (1 + c_custkey % 6)) as hw_predict", "c_custkey % 11 / 10 as score")
    of = lambda n: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for t, v in tiers.items() for x in (t, v[n])]), F.col("tier")), F.lit(tiers["free"][n]))
    feature = F.when(F.col("score") < 0.3, "starter").when(F.col("score") <= 0.7, "growth").otherwise("full")
    return asked.select("id", "tier", F.least("hw_ctx", of(0)).alias("num_ctx"), F.least("hw_predict", of(1)).alias("num_predict"), feature.alias("feature"))
