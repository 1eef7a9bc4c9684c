"""Rules of statutes, decisions, citations, logs and metrics on rows worked by hand: each function's result against the rows of its SQL."""

import pytest
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.catalog import inline
from codexmill.functions import guard
from codexmill.functions import legal as L
from codexmill.functions import text as X
from codexmill.operators import audit, evaluation, graph
from codexmill.operators import retrieval as R
from codexmill.plans.retrieval import aliases, mentions

from oracle import same

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT * FROM (VALUES ('Panduan', 1, 'Awal', 72), ('Panduan', 3, 'Bagian dua', 60)) t(doc, pos, title, chars)
""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections at second and third level headings of 60 characters or more, titles cut at 80."""
    body = "# Panduan\npembuka\n## Awal\n" + "a" * 72 + "\n### Pendek\nkecil\n## Bagian dua\n" + "b" * 60 + "\n"
    m = inline(spark, "text string", [(body,)])
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{2,3}\s+(.+)$"), 1)
    parts = F.split("text", r"(?m)^#{2,3}\s+.+$")
    s = m.select(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("doc"), heads.alias("heads"), F.posexplode(parts).alias("pos", "body")).where("pos > 0")
    s = s.select("doc", "pos", F.substring(X.strip(F.get("heads", F.col("pos") - 1)), 1, 80).alias("title"), X.strip(F.col("body")).alias("body"))
    return s.where(F.length("body") >= 60).select("doc", "pos", "title", F.length("body").alias("chars"))


A1, A2, A3 = "Dalam aturan ini yang dimaksud dengan uji adalah uji.", "Setiap uji dilakukan oleh penguji yang ditunjuk khusus.", "Ketentuan lebih lanjut diatur dengan aturan pelaksana."


STATUTE = f"UNDANG-UNDANG NOMOR 9 TAHUN 2031 TENTANG UJI\nMenimbang: {'pertimbangan ' * 18}\nBAB I\nKETENTUAN UMUM\nPasal 1\n{A1}\nBAB II\nPENGUJIAN\nBagian Kesatu\nUmum\nPasal 2.\n{A2}\nParagraf 1\nCara\nPasal 3 ..... 7\npendek\nPasal 3\n{A3}\nPasal 2\n{A1} ulang\nBAB III\nPENUTUP\nPasal 4\n{A3}\nPENJELASAN ATAS\nPasal 1\n{A2}\n"


@query(f"""
SELECT * FROM (VALUES (1, 'Konsiderans', 'Konsiderans', NULL), (1, 'Pasal 1', 'BAB I KETENTUAN UMUM', '{A1}'), (1, 'Pasal 2', 'BAB II PENGUJIAN · Bagian Kesatu Umum', '{A2}'),
 (1, 'Pasal 3', 'BAB II PENGUJIAN · Bagian Kesatu Umum · Paragraf 1 Cara', '{A3}'), (1, 'Pasal 4', 'BAB III PENUTUP', '{A3}')) t(id, article_number, hierarchy, body)
""")
def article_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statute split into articles with their chapter, part and paragraph; first lines of the bodies."""
    a = L.articles(inline(spark, "doc_id int, text string", [(1, STATUTE), (2, "tanpa penanda"), (3, None)]))
    first = F.substring_index(F.regexp_replace("content", r"^\[[^\]]*\]\n", ""), "\n", 1)
    return a.select("id", "article_number", "hierarchy", F.when(F.col("article_number") != "Konsiderans", first).alias("body"))


@query("SELECT * FROM (VALUES (1, 5::bigint)) t(id, n)")
def split_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preamble and four articles: short bodies, repeated numbers and the explanation do not count."""
    return L.articles(inline(spark, "doc_id int, text string", [(1, STATUTE)])).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT * FROM (VALUES (1, 'UNDANG-UNDANG REPUBLIK NOMOR 8 TAHUN 2030', '8', '2030', 'PENGUJIAN MUTU', 2, 'Uji', 'Berlaku', 'https://x/UU%20Nomor%208%20Tahun%202030.pdf'),
 (2, 'PERATURAN DAERAH KOTA', NULL, NULL, NULL, 0, NULL, 'Dicabut', 'https://x/a.pdf'), (3, 'Unknown Law', NULL, NULL, NULL, 0, NULL, NULL, NULL)) t(id, name, number, year, subject, chapters, topic, status, link)
""")
def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inline(spark, "id int, text string, page string, links array<string>", [
        (1, "UNDANG-UNDANG REPUBLIK\nNOMOR 8 TAHUN 2030\nTENTANG\nPENGUJIAN MUTU\nDENGAN RAHMAT X\nMengingat: UU Nomor 1 Tahun 1999\nBAB I\nSubjek: Uji\nBAB II\nStatus\n Berlaku\n", "https://x/uu-no-8-tahun-2030", ["https://x/UU%20Nomor%207%20Tahun%202030.pdf", "https://x/UU%20Nomor%208%20Tahun%202030.pdf"]),
        (2, "PERATURAN DAERAH KOTA\nmenimbang\nStatus: Dicabut", "https://x/lain", ["https://x/a.pdf", "https://x/b.pdf"]), (3, "catatan bebas", "https://x", [])])
    return d.select("id", L.title(F.col("text")).alias("t"), L.labelled(F.col("text"), "Subjek").alias("topic"), L.labelled(F.col("text"), "Status").alias("status"), L.best_link(F.col("page"), F.col("links")).alias("link")).select("id", "t.*", "topic", "status", "link")


OFFENCES = [
    (1, "Pasal 7 (1) Setiap Orang dengan sengaja dan tanpa hak mengakses sistem milik orang lain dipidana dengan pidana penjara paling singkat 2 (dua) tahun dan paling lama 8 (delapan) tahun dan/atau denda paling banyak Rp800.000.000,00."),
    (2, "Barang siapa mengambil barang milik orang lain diancam dengan pidana penjara paling lama lima tahun atau pidana kurungan paling lama 6 bulan"),
    (3, "Setiap Orang yang melakukan perbuatan itu dipidana dengan pidana penjara seumur hidup atau pidana penjara paling singkat 18 bulan, pidana ditambah sepertiga"),
    (4, "Ketentuan umum tentang uji."),
    (5, None),
    (6, "Perbuatan terlarang dipidana dengan pidana mati atau denda sebesar Rp 5.000"),
]


@query("""
SELECT * FROM (VALUES (1, 'Setiap Orang', 'mengakses sistem milik orang lain', 'dengan sengaja,tanpa hak', 2.0::double, 8.0::double, FALSE, FALSE, NULL::double, 800000000.0::double, FALSE, 'dipidana'),
 (2, 'Barang siapa', 'mengambil barang milik orang lain', '', NULL, 5.0, FALSE, FALSE, 0.5, NULL, FALSE, 'diancam'),
 (3, 'Setiap Orang', 'melakukan perbuatan itu', '', 1.5, NULL, TRUE, FALSE, NULL, NULL, TRUE, 'dipidana'),
 (6, 'subjek tidak eksplisit', 'Perbuatan terlarang', '', NULL, NULL, FALSE, TRUE, NULL, 5000.0, FALSE, 'dipidana')) t(id, pelaku, perbuatan, sikap_batin, penjara_min, penjara_maks, seumur_hidup, pidana_mati, kurungan_maks, denda_rp, pemberatan, dipidana_di)
""")
def offence_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inline(spark, "id int, content string", OFFENCES).select("id", L.elements(F.col("content")).alias("e")).where("e is not null").select("id", "e.*")
    return e.withColumn("sikap_batin", F.array_join("sikap_batin", ","))


R1, R2 = "terdakwa hadir di persidangan dan mengakui perbuatannya", "barang bukti telah disita secara sah menurut ketentuan"


DECISIONS = [
    ("a", 1, "Kepala", "x"), ("a", 2, "pertimbangan hukum", f"Pembuka. Menimbang, bahwa {R1}; Menimbang bahwa pendek; Menimbang, {R2} Pasal 112 ayat (1) UU No. 35 Tahun 2009"), ("a", 3, "amar putusan", "Menyatakan terdakwa terbukti secara sah dan meyakinkan bersalah melakukan uji; Menjatuhkan pidana penjara selama 4 tahun; melanggar Pasal 112"),
    ("b", 1, "amar", "Membebaskan terdakwa dari dakwaan"), ("c", 1, "amar", "Menolak permohonan"), ("d", 1, "Kepala", "y"),
]


@query(f"""
SELECT * FROM (VALUES ('a', '{R1};|{R2} Pasal 112 ayat (1) UU No. 35 Tahun 2009', 'Pasal 112 ayat (1) UU No. 35 Tahun 2009', TRUE, 'terbukti secara sah dan meyakinkan bersalah melakukan', 'Pasal 112', '4 tahun', 'menjatuhkan,menyatakan'),
 ('b', '', NULL, FALSE, 'membebaskan', '', NULL, 'membebaskan'), ('c', '', NULL, NULL, NULL, '', NULL, 'menolak'), ('d', '', NULL, NULL, NULL, NULL, NULL, NULL)) t(decision_id, ratio, pasal_pertimbangan, terbukti, status, pasal_amar, hukuman, diksi)
""")
def decision_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = L.holdings(inline(spark, "decision_id string, pos int, title string, content string", DECISIONS))
    return h.withColumns({"ratio": F.array_join("ratio", "|")} | {c: F.array_join(c, ",") for c in ("pasal_pertimbangan", "pasal_amar", "diksi")})


@query("SELECT * FROM (VALUES ('UU X', 'Pasal 1', 'KUHP', 'Pasal 55'), ('UU X', 'Pasal 1', 'UU Nomor 7', 'Pasal 3A'), ('UU X', 'Pasal 2', 'Undang-Undang No. 9/2001', 'Pasal 4')) t(law_name, article_number, to_law, to_article)")
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("UU X", "Pasal 1", "lihat Pasal 55 ayat (1) KUHP dan Pasal 55 KUHP serta Pasal 3A UU Nomor 7, juga Pasal 1 KUHP"), ("UU X", "Pasal 2", "Pasal 4 Undang-Undang No. 9/2001"), ("UU X", "Pasal 3", None)]
    return L.cross_references(inline(spark, "law_name string, article_number string, content string", rows))


@query("""
SELECT * FROM (VALUES ('s1', 'Narkotika', 'Pasal 112'), ('s1', 'KUHP lama', 'Pasal 55'), ('s2', 'Narkotika', 'Pasal 1'), ('s2', 'Kepolisian', 'Pasal 3')) t(article_number, to_law, to_article)
""")
def decision_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("s1", "Pasal 112 ayat (1) UU RI Nomor 35 Tahun 2009 dan UU Nomor 35 Tahun 2009, Pasal 55 KUHP, Pasal 9 UU No. 4 Tahun 1900"), ("s2", "Mengingat UU No. 035 Tahun 2009 dan Pasal 3 Undang-Undang Nomor 2 Tahun 2002; UU Nomor 2 Tahun 2002"), ("s3", None)]
    laws = [("35", "2009", "Narkotika"), ("1", "1946", "KUHP lama"), ("2", "2002", "Kepolisian")]
    return L.decision_citations(inline(spark, "article_number string, content string", rows), inline(spark, "number string, year string, law_name string", laws))


@query("""
SELECT * FROM (VALUES (1, 'revokes', 'UU Nomor 5 Tahun 1999'), (1, 'revokes', 'UU Nomor 6 Tahun 2000'), (2, 'amends', 'UU Nomor 7 Tahun 2001'), (3, 'amended_by', 'UU Nomor 8 Tahun 2002'), (4, 'amends', 'UU Nomor 9 Tahun 2003')) t(id, relation, target)
""")
def amend_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (1, "Undang-undang ini mencabut UU Nomor 05 Tahun 1999. Undang-Undang Nomor 6 Tahun 2000 dinyatakan tidak berlaku.", "10", "2020"),
        (2, "Mengubah beberapa ketentuan UU Nomor 7 Tahun 2001. Lihat pula UU Nomor 70 Tahun 2001.", "10", "2020"),
        (3, "sebagaimana telah diubah dengan UU Nomor 8 Tahun 2002", "10", "2020"),
        (4, "UU No. 9 Tahun 2003 diubah dengan undang-undang ini. Mencabut. UU Nomor 10 Tahun 2020 mengatur.", "10", "2020"),
    ]
    return L.relations(inline(spark, "id int, text string, own_number string, own_year string", rows))


@query("SELECT * FROM (VALUES (1, ''), (2, '2015'), (3, '1998,2020'), (4, ''), (5, '')) t(id, years)")
def event_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = inline(spark, "id int, q string", [(1, "isi UU Nomor 8 Tahun 1981"), (2, "uji pada 2015 menurut UU 19/2016"), (3, "dari 2020 kembali ke 1998, lalu 1900"), (4, "tidak ada"), (5, None)])
    return q.select("id", F.array_join(F.transform(L.event_years(F.col("q")), lambda y: y.cast("string")), ",").alias("years"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, FALSE), (4, FALSE)) t(id, matches)")
def subject_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of five words and all discriminating ones; two of five; a discriminating word missing; no subject."""
    rows = [(1, ["alpha", "betas", "gamma", "delta", "epsil"], ["gamma"], "ALPHA betas GAMMA"), (2, ["alpha", "betas", "gamma", "delta", "epsil"], [], "alpha betas"), (3, ["alpha"], ["gamma"], "alpha"), (4, ["alpha"], [], None)]
    return inline(spark, "id int, words array<string>, must array<string>, subject string", rows).select("id", L.subject_match(F.col("words"), F.col("must"), F.col("subject")).alias("matches"))


@query("""
SELECT * FROM (VALUES (1, NULL, 'materiil'), (2, 'too_few_articles', 'regulasi'), (3, 'identity', 'formil'), (4, 'subject', 'regulasi'), (5, 'obsolete', 'regulasi'), (6, 'duplicate', 'materiil'), (7, 'registered', 'regulasi')) t(id, reject_reason, category)
""")
def verify_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates pass checks in order; the first of an identity wins; known identities are rejected."""
    rows = [(1, 9, "7", "2017", True, "Berlaku", "UU Narkotika"), (2, 4, "8", "2017", True, None, "UU X"), (3, 9, None, "2017", True, None, "Hukum Acara"), (4, 9, "9", "2017", False, None, "UU X"), (5, 9, "10", "2017", True, "Tidak Berlaku / Dicabut", "UU X"), (6, 9, "07", "2017", True, None, "UU Pidana"), (7, 9, "11", "2017", True, None, "UU X")]
    c = inline(spark, "id int, n_articles int, number string, year string, subject boolean, status string, name string", rows)
    known = inline(spark, "number string, year string", [("11", "2017")]).withColumn("known", F.lit(True))
    c = c.withColumn("number", X.no_zeros(F.col("number"))).withColumn("nth", F.row_number().over(Window.partitionBy("number", "year").orderBy("id"))).join(known, ["number", "year"], "left")
    reason = L.reject_reason(F.col("n_articles"), F.col("number").isNotNull() & F.col("year").isNotNull(), F.col("subject"), F.col("status"), F.col("nth") > 1, F.coalesce("known", F.lit(False)))
    return c.select("id", reason.alias("reject_reason"), L.category(F.col("name")).alias("category"))


@query("""
SELECT * FROM (VALUES (1, 2::bigint, 1::bigint, 'Pasal 99', '', ''), (2, 1, 1, '', 'Pasal 5', 'Pasal 5 (UU 2020 > 2015)'), (3, 0, 0, '', '', '')) t(id, cited, verified, unverified, low_fidelity, anachronisms)
""")
def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = inline(spark, "id int, query string, summary string", [(1, "apa", "Menurut Pasal 005 pencurian barang dilarang. Juga Pasal 99 berlaku."), (2, "kejadian 2015", "Pasal 5 mengatur perkawinan campuran internasional."), (3, None, None)])
    sources = inline(spark, "id int, law_name string, article_number string, content string", [(1, "UU Nomor 1 Tahun 1946", "Pasal 5", "Pencurian barang dilarang keras"), (2, "UU Nomor 3 Tahun 2020", "Pasal 5", "pencurian")])
    return L.citation_audit(answers, sources)


@query(r"""
SELECT * FROM (VALUES (1, '7', 'a b', 'halo-dunia-2', 'x.org', 'a/b c', 'a.; b!', 0.8::double, 'ZWFz', 'c.txt', 1::bigint, 'uu nomor 7', '{"k": 1}'),
 (2, '0', '', '', '', NULL, '', 0.0, '', '', 0, 'abc', NULL)) t(id, zeros, collapsed, slug, host, decoded, sents, clamped, b64, base, tok, hint, json)
""")
def scalar_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a scalar function."""
    r = inline(spark, "id int, n string, s string, t string, url string, enc string, sents string, score string, b string, path string, q string, j string", [
        (1, "007", " a \t b ", "Halo, Dunia 2!", "https://www.x.org:80/p", "a%2Fb%20c", "a.; b!", "nilai 0.8", "eas", "a/b/c.txt", "isi UU Nomor 7 itu", 'x {"k": 1} y'), (2, "000", "", "--", "tanpa", None, "", "kosong", "", "", "abc", "none")])
    return r.select(
        "id",
        X.no_zeros(F.col("n")).alias("zeros"),
        X.collapse(F.col("s")).alias("collapsed"),
        X.slug(F.col("t")).alias("slug"),
        X.host(F.col("url")).alias("host"),
        F.try_url_decode("enc").alias("decoded"),
        F.array_join(X.sentences(F.col("sents")), " ").alias("sents"),
        F.expr(r"greatest(0, least(1, coalesce(try_cast(nullif(regexp_extract(score, '[0-9]+(?:\\.[0-9]+)?', 0), '') as double), 0)))").cast("double").alias("clamped"),
        F.base64(F.col("b").cast("binary")).alias("b64"),
        F.element_at(F.split("path", "/"), -1).alias("base"),
        F.ceil(F.length("b") / 4).alias("tok"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract("q", r"(?i)uu nomor \d+", 0)), F.lit("")), F.substring("q", 1, 60)).alias("hint"),
        F.nullif(F.regexp_extract("j", r"(?s)\{.*\}", 0), F.lit("")).alias("json"),
    )


@query("""
SELECT query_id, id, boost FROM (VALUES
  (1, 'a', 0.08::double), (1, 'b', 0.04), (1, 'c', 0.01), (2, 'd', 0.04), (3, 'a', 0.04), (3, 'b', 0.04), (3, 'e', 0.04), (4, 'e', 0.08), (4, 'd', 0.01)
) t(query_id, id, boost)
""")
def mention_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked by hand: query 1 names law 7/2017 and article 12; 2 names one by an alias; 3 by a short form; 4 an article of an alias's law; 5 nothing."""
    q = inline(spark, "query_id int, query string", [(1, "apa isi Pasal 12 UU Nomor 7 Tahun 2017"), (2, "aturan KDRT di rumah"), (3, "lihat uu 7/2017 dan no. 35 tahun 2009"), (4, "pasal 5b narkoba"), (5, "cuaca hari ini")])
    c = inline(spark, "id string, law_name string, article_number string", [("a", "UU Nomor 7 Tahun 2017 tentang Uji", "Pasal 12"), ("b", "UU No. 7 Tahun 2017", "Pasal 13"), ("c", "UU Nomor 9 Tahun 2011", "Pasal 12"), ("d", "UU Nomor 23 Tahun 2004", "Pasal 5B"), ("e", "UU 35 Tahun 2009", "pasal 5b"), ("f", "lain", "Pasal 99")])
    return mentions(q, c, aliases(spark)).select("query_id", "id", F.round("boost", 4).alias("boost"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, TRUE), (3, FALSE), (4, FALSE), (5, TRUE)) t(id, asks)")
def case_law_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Putusan MA soal bukti elektronik"), (2, "apakah ada YURISPRUDENSI"), (3, "isi pasal 12"), (4, None), (5, "doktrin  putusan")]
    return inline(spark, "id int, q string", rows).select("id", R.asks_case_law(F.col("q")).alias("asks"))


@query("SELECT * FROM (VALUES (1, '2031-02-03T04:05'), (2, '2030-01-01'), (3, NULL), (4, NULL)) t(id, published)")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '<meta property="article:published_time" content="2031-02-03T04:05"><meta name="publishdate" content="x">'), (2, '<META name="publishdate" content="2030-01-01">'), (3, '<meta name="publishdate" content="">'), (4, None)]
    return inline(spark, "id int, html string", rows).select("id", X.page_date(F.col("html")).alias("published"))


@query("""
SELECT * FROM (VALUES ('edge', 'A', 'REVOKES', 'B'), ('edge', 'A', 'AMENDS', 'C'), ('edge', 'D', 'AMENDS', 'A'), ('edge', 'E', 'AMENDS', 'A'),
 ('vertex', 'A', NULL, NULL), ('vertex', 'B', NULL, NULL), ('vertex', 'C', NULL, NULL), ('vertex', 'D', NULL, NULL), ('vertex', 'E', NULL, NULL)) t(kind, src, rel, dst)
""")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law A revokes B, amends C and is amended by D; E amends it too; F has no relation."""
    laws = inline(spark, "name string, revokes array<string>, amends array<string>, amended_by array<string>", [("A", ["B", "B"], ["C"], ["D"]), ("E", [], ["A"], None), ("F", [], [], [])])
    e, v = graph.document_relations(laws)
    none = F.lit(None).cast("string")
    return e.select(F.lit("edge").alias("kind"), "src", "rel", "dst").unionByName(v.select(F.lit("vertex").alias("kind"), F.col("id").alias("src"), none.alias("rel"), none.alias("dst")))


@query("""
SELECT * FROM (VALUES (1, TRUE), (2, FALSE), (3, TRUE), (4, TRUE), (5, TRUE), (6, FALSE), (7, TRUE), (8, FALSE)) t(id, matches)
""")
def node_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical with its own word and without; an alternative; the synonym; the plan's title; nothing; the source's subject where the law has none; an empty topic."""
    rows = [
        (1, "uu uji", "Undang-Undang tentang Pemberantasan Pengujian Barang", ["pengujian"], "x", "PEMBERANTASAN PENGUJIAN", None, None),
        (2, "uu uji", "Undang-Undang tentang Pemberantasan Pengujian Barang", ["pengujian"], "x", "Pemberantasan Barang", None, None),
        (3, "perikanan/kehutanan", None, None, "x", "Pengelolaan Kehutanan", None, None), (4, "Perkap/Perja", None, None, "x", "Peraturan Kepolisian Negara", None, None),
        (5, "lainnya", None, None, "Hukum Pelayaran", "hukum pelayaran niaga", None, None), (6, "perikanan", None, None, "x", "kehutanan", "perikanan", None),
        (7, "perikanan", None, None, "x", "", "Perikanan", "UU X"), (8, "", None, None, "", "perikanan", None, None)]
    r = inline(spark, "id int, topic string, canonical string, must array<string>, title string, subject string, source string, name string", rows)
    return r.select("id", L.node_match(*[F.col(c) for c in r.columns[1:]]).alias("matches"))


@query("SELECT * FROM (VALUES (1, 'pengujian,barang', 'formil'), (2, 'mineral', 'yurisprudensi'), (3, '', 'regulasi'), (4, 'pelayaran', 'materiil'), (5, '', 'formil')) t(id, words, category)")
def law_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a law's subject and its category by code."""
    rows = [(1, "Peraturan tentang tentang Pengujian Barang atas pengujian", "KUHAP2025"), (2, "Mineral", "PUTUSAN1"), (3, None, "KPK"), (4, "UU tentang X tentang Pelayaran Negara", "ITE"), (5, "tentang", "MILITER")]
    return inline(spark, "id int, name string, code string", rows).select("id", F.array_join(L.subject_words(F.col("name")), ",").alias("words"), L.code_category(F.col("code")).alias("category"))


@query("SELECT * FROM (VALUES ('kuhp', 1.0::double), ('ite', 0.3), ('kdrt', 0.0), ('acara', 0.8), ('lain', 0.0)) t(node, score)")
def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = inline(spark, "node string, canonical boolean", [("kuhp", True), ("ite", True), ("kdrt", True), ("acara", False), ("lain", False)])
    expected = inline(spark, "node string, number string, year string", [("kuhp", "1", "2023"), ("ite", "11", "2008"), ("ite", "1", "2024"), ("kdrt", "23", "2004")])
    return evaluation.node_scores(nodes, expected, inline(spark, "node string, number string, year string", [("kuhp", "1", "2023"), ("kuhp", "9", "1999"), ("ite", "1", "2023"), ("acara", "5", "2001")]))


@query("SELECT * FROM (VALUES (1, 'a,b', 'x = 1'), (2, NULL, 'cut' || chr(10) || 'here'), (3, NULL, NULL), (4, '', 'k'), (5, NULL, NULL)) t(id, categories, code)")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array and an object in free text; an object cut off; text without any; an array without categories; null."""
    rows = [(1, 'so [{"category": "a"}, {"x": 1}, {"category": "b"}] ', 'out {"code": "x = 1", "n": 2} end'), (2, "[1, 2", '{"n": 1, "code": "cut\\nhere'), (3, "none", "none"), (4, '[{"category": ""}]', '{"code": "k"}'), (5, None, None)]
    r = inline(spark, "id int, a string, o string", rows)
    return r.select("id", F.array_join(F.transform(X.json_objects(F.col("a"), "category string", "category"), lambda o: o["category"]), ",").alias("categories"), X.json_field(F.col("o"), "code").alias("code"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, TRUE), (3, TRUE), (4, FALSE), (5, FALSE), (6, TRUE)) t(id, valid)")
def uuid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of UUIDs, a short one, null, and one made here."""
    rows = [(1, "12345678-1234-5678-1234-567812345678"), (2, "{12345678123456781234567812345678}"), (3, "urn:uuid:12345678-1234-5678-1234-56781234567F"), (4, "1234"), (5, None), (6, "new")]
    value = F.when(F.col("v") == "new", F.uuid()).otherwise(F.col("v"))
    return inline(spark, "id int, v string", rows).select("id", X.valid_uuid(value).alias("valid"))


CODE = [
    (1, "import csv, json\nfrom re import sub\nprint(1)", "hitung"),
    (2, "import os, numpy\nos.environ['A']\neval('1')", "x"),
    (3, "open('a.txt', 'w')", "baca bukti"),
    (4, "  ", "x"),
    (5, "from subprocess import run\nimport yaml\np.write_text('a')\nx = '../b'", "x"),
    (6, "def _sha256(f): pass\nopen('/etc/x')  # sha256", "x"),
    (7, None, None),
]


@query("""
SELECT * FROM (VALUES (1, '', TRUE, FALSE), (2, 'attribute:os.environ,call:eval,environment,import:os,module:os', FALSE, FALSE), (3, 'mode:w,write_mode', FALSE, TRUE), (4, 'empty', FALSE, FALSE),
  (5, 'import:subprocess,method:write_text,module:subprocess,module:yaml,path_traversal', FALSE, FALSE), (6, 'system_path', FALSE, FALSE), (7, 'empty', FALSE, FALSE)) t(id, violations, allowed, unhashed)
""")
def code_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inline(spark, "id int, code string, description string", CODE).withColumn("v", guard.violations(F.col("code")))
    return c.select("id", F.array_join("v", ",").alias("violations"), (F.size("v") == 0).alias("allowed"), guard.unhashed_open(F.col("code")).alias("unhashed"))


@query("SELECT * FROM (VALUES (1, FALSE, FALSE), (2, FALSE, FALSE), (3, TRUE, TRUE), (4, FALSE, FALSE), (5, FALSE, FALSE), (6, FALSE, FALSE), (7, FALSE, FALSE)) t(id, needs, injected)")
def custody_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the third speaks of evidence without a scaffold of its own."""
    c = inline(spark, "id int, code string, description string", CODE)
    code, description = F.col("code"), F.col("description")
    led = guard.with_custody(code, description, F.lit("# custody"))
    return c.select("id", guard.needs_custody(code, description).alias("needs"), F.coalesce(F.startswith(led, F.lit("# custody")), F.lit(False)).alias("injected"))


HITS = [(1, "a", "POST", "/auth/login", 0.0), (2, "a", "POST", "/auth/login", 10.0), (3, "a", "POST", "/auth/login", 20.0), (4, "a", "POST", "/auth/login", 61.0), (5, "a", "POST", "/auth/login", 65.0), (6, "b", "POST", "/auth/login", 20.0), (7, "a", "GET", "/auth/login", 21.0), (8, "a", "POST", "/analyse", 22.0), (9, "a", "POST", "/analyse", 22.5), (10, "c", "POST", "/analyse", 0.0), (11, "c", "POST", "/analyse", 60.0), (12, "c", "POST", "/analyse", 60.5)]


@query("""
SELECT * FROM (VALUES (1::bigint, 1, TRUE, NULL::int), (2, 1, TRUE, NULL), (3, 1, FALSE, 41), (4, 1, TRUE, NULL), (5, 1, FALSE, 6), (6, 1, TRUE, NULL), (7, NULL, TRUE, NULL), (8, 2, TRUE, NULL), (9, 2, FALSE, 60), (10, 2, TRUE, NULL), (11, 2, FALSE, 1), (12, 2, TRUE, NULL)) t(id, rule, admitted, retry_after)
""")
def rate_limit_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logins or one analysis a minute. Worked by hand: the rejected hit at 20 s is not recorded, so 61 s sees one hit (10 s); a hit exactly 60 s old still counts."""
    hits = inline(spark, "id long, ip string, method string, path string, ts double", HITS)
    rules = inline(spark, "rule int, method string, prefix string, max_hits int, window_s int", [(1, "POST", "/auth/login", 2, 60), (2, "POST", "/analyse", 1, 60), (3, "POST", "/", 100, 60)])
    return audit.rate_limit(hits, rules).select("id", "rule", "admitted", "retry_after")


EDGES = [("UU A", "CITES", "UU B"), ("UU A", "CITES", "UU B"), ("Putusan 1", "CITES", "UU B"), ("PP C", "CITES", "UU A"), ("PP C", "CITES", "PP C"), ("PP D", "CITES", "UU X")]


@query("SELECT * FROM (VALUES ('UU B', 'SUPERIOR_TO', 'UU A'), ('UU A', 'SUPERIOR_TO', 'PP C'), ('UU X', 'SUPERIOR_TO', 'PP D')) t(src, rel, dst)")
def hierarchy_superior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.superior(inline(spark, "src string, rel string, dst string", EDGES), lambda c: c.startswith("Putusan"))


@query("""
SELECT * FROM (VALUES ('edge', 'UU A', 'UU B'), ('edge', 'PP C', 'UU A'), ('edge', 'PP C', 'PP C'), ('vertex', 'UU A', NULL), ('vertex', 'PP C', NULL), ('vertex', 'UU B', NULL)) t(kind, src, dst)
""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of known sources; a missing target becomes a vertex."""
    e, v = graph.merge_edges(inline(spark, "src string, rel string, dst string", EDGES), inline(spark, "id string", [("UU A",), ("PP C",)]), True)
    return e.select(F.lit("edge").alias("kind"), "src", "dst").unionByName(v.select(F.lit("vertex").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")))


@query("""
SELECT * FROM (VALUES ('free', 2048, 512, 'starter'), ('level1', 4096, 512, 'growth'), ('level2', 4096, 2048, 'full'), ('gold', 2048, 512, 'growth')) t(tier, num_ctx, num_predict, feature)
""")
def tier_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of a tier's and the hardware's budget; an unknown tier is free. Features by score thresholds."""
    # Context and generation lengths of the tiers.
    tiers = inline(spark, "tier string, ctx int, predict int", [("free", 2048, 512), ("level1", 8192, 2048), ("level2", 16384, 4096)])
    asked = inline(spark, "tier string, hw_ctx int, hw_predict int, score double", [("free", 4096, 2048, 0.2), ("level1", 4096, 512, 0.3), ("level2", 4096, 2048, 0.71), ("gold", 8192, 2048, 0.7)])
    free = tiers.where("tier = 'free'").select(F.col("ctx").alias("free_ctx"), F.col("predict").alias("free_predict"))
    j = asked.join(F.broadcast(tiers), "tier", "left").join(F.broadcast(free))
    feature = F.when(F.col("score") < 0.3, "starter").when(F.col("score") <= 0.7, "growth").otherwise("full")
    return j.select("tier", F.least("hw_ctx", F.coalesce("ctx", "free_ctx")).alias("num_ctx"), F.least("hw_predict", F.coalesce("predict", "free_predict")).alias("num_predict"), feature.alias("feature"))


@query("SELECT * FROM (VALUES (1, 'no_evidence'), (2, 'weak_evidence'), (3, 'ungrounded_citations'), (4, NULL), (5, NULL)) t(question_id, abstained)")
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No article; best score below 0.55; two citations or more and none verified."""
    a = inline(spark, "question_id int, scores array<double>, cited int, verified int", [(1, [], 3, 0), (2, [0.2, 0.54], 3, 0), (3, [0.8], 2, 0), (4, [0.55, 0.1], 1, 0), (5, [0.9], 4, 1)])
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    reason = F.when(F.size("scores") == 0, "no_evidence").when(best < 0.55, "weak_evidence").when((F.col("cited") >= 2) & (F.col("verified") == 0), "ungrounded_citations")
    return a.select("question_id", reason.alias("abstained"))


@query("SELECT 4::bigint AS n, 0.5::double AS hit_rate, 0.3333::double AS mrr, 0.6667::double AS covered_hit_rate, 0.75::double AS coverage")
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked by hand: ranks 1, 3, none and a hit beyond ten; three of four laws are registered; (1 + 1/3) / 4."""
    gold = inline(spark, "question_id int, question string, law_number string, law_year string, pasal string", [(1, "x", "07", "2017", "12"), (2, "apa isi Nomor 9 Tahun 2001, yaitu Pasal 03B?", None, None, None), (3, "x", "5", "1999", "1"), (4, "x", "6", "2000", "8")])
    results = inline(spark, "question_id int, rank int, law_name string, article_number string", [(1, 1, "UU Nomor 7 Tahun 2017", "Pasal 012"), (1, 2, "UU Nomor 7 Tahun 2017", "Pasal 12"), (2, 1, "UU Nomor 9 Tahun 2002", "Pasal 3"), (2, 3, "UU Nomor 9 Tahun 2001", "Pasal 3"), (3, 1, "UU Nomor 5 Tahun 1999", ""), (4, 11, "UU Nomor 6 Tahun 2000", "Pasal 8")])
    registry = inline(spark, "number string, year string", [("7", "2017"), ("009", "2001"), ("6", "2000"), ("7", "2017")])
    return evaluation.metrics(evaluation.first_hits(results, evaluation.gold_keys(gold)), registry, 10)


@query("""
SELECT * FROM (VALUES (1, TRUE, 0.5::double, 1.0::double, TRUE, TRUE, 'sikap'), (2, FALSE, 1.0, 0.5, FALSE, FALSE, 'pelaku,penjara,denda'), (3, FALSE, 0.0, 0.0, FALSE, FALSE, 'no_elements')) t(id, pelaku, recall, prec, penjara, denda, status)
""")
def element_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against extracted elements: shares of the mens-rea phrases, equal bounds, fine at least as expected."""
    g = inline(spark, "id int, want_pelaku string, want_sikap array<string>, want_max double, want_denda double, pelaku string, sikap array<string>, got_max double, got_denda double", [
        (1, "orang", ["a", "b"], 8.0, 100.0, "setiap orang", ["a"], 8.0, 150.0), (2, "badan", ["a"], 8.0, 100.0, "setiap orang", ["a", "c"], 7.0, 50.0), (3, "orang", ["a"], 1.0, 1.0, None, None, None, None)])
    common = F.size(F.array_intersect("want_sikap", F.coalesce("sikap", F.array().cast("array<string>"))))
    got = F.coalesce(F.size(F.col("sikap")), F.lit(0))
    s = g.select(
        "id",
        F.coalesce(F.contains("pelaku", F.col("want_pelaku")), F.lit(False)).alias("pelaku"),
        F.when(F.size("want_sikap") == 0, 1.0).otherwise(common / F.size("want_sikap")).alias("recall"),
        F.when(F.col("sikap").isNull(), 0.0).otherwise(common / F.greatest(got, F.lit(1))).alias("prec"),
        F.coalesce(F.col("want_max") == F.col("got_max"), F.lit(False)).alias("penjara"),
        F.coalesce(F.col("got_denda") >= F.col("want_denda"), F.lit(False)).alias("denda"),
        F.col("sikap").isNull().alias("none"),
    )
    failing = F.array_compact(F.array(F.when(~F.col("pelaku"), "pelaku"), F.when(F.col("recall") < 1, "sikap"), F.when(~F.col("penjara"), "penjara"), F.when(~F.col("denda"), "denda")))
    return s.withColumn("status", F.when(F.col("none"), "no_elements").when(F.size(failing) == 0, "ok").otherwise(F.array_join(failing, ","))).drop("none")


@query("SELECT * FROM (VALUES (1, 'example.org', 1.0::double, 255), (2, NULL, 0.5, 3), (3, 'a.b', 0.5, 4)) t(id, source_domain, verification_score, name_chars)")
def registry_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows: third slash token of the url, score by verification, name cut at 255."""
    r = inline(spark, "id int, url string, verified boolean, law_name string", [(1, "https://example.org/x/y", True, "n" * 300), (2, "nothing", False, "abc"), (3, "http://a.b", None, "abcd")])
    return r.select("id", F.get(F.split("url", "/"), F.lit(2)).alias("source_domain"), F.when(F.col("verified"), 1.0).otherwise(0.5).alias("verification_score"), F.length(F.substring("law_name", 1, 255)).alias("name_chars"))


@query("SELECT * FROM (VALUES ('x', 2::bigint, 0.55::double, 1::bigint, 'gap_detected'), ('y', 1, 0.9, 0, 'completed')) t(node, n, mean, gaps, status)")
def self_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiz scores read from free text, clamped; the mean decides, and low answers are gaps."""
    q = inline(spark, "node string, answer string", [("x", "score: 0.9 of 1"), ("x", "about 0.2"), ("y", "0.9")])
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.expr(r"coalesce(try_cast(nullif(regexp_extract(answer, '[0-9]+(?:\\.[0-9]+)?', 0), '') as double), 0.0)")))
    g = q.withColumn("score", score).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("mean"), F.count_if(F.col("score") < 0.7).alias("gaps"))
    return g.withColumn("status", F.when(F.col("mean") >= 0.7, "completed").otherwise("gap_detected"))


@query("SELECT * FROM (VALUES (1, 30::bigint), (2, NULL), (3, NULL), (4, NULL)) t(id, eta_s)")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left at the pace so far; null unless 0 < done < total."""
    j = inline(spark, "id int, elapsed double, done int, total int", [(1, 10.0, 1, 4), (2, 10.0, 0, 4), (3, 10.0, 4, 4), (4, 10.0, None, 4)])
    return j.select("id", F.when((F.col("done") > 0) & (F.col("done") < F.col("total")), F.round(F.try_divide("elapsed", "done") * (F.col("total") - F.col("done"))).cast("long")).alias("eta_s"))


@query("""
SELECT * FROM (VALUES ('1', 1), ('2', 2), ('2A', 3), ('10', 4), ('10B', 5), ('Konsiderans', 6), ('Penutup', 7)) t(article, pos)
""")
def natural_sort_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article numbers by their number, then text; those without a number last."""
    a = inline(spark, "article string", [("10B",), ("2",), ("Penutup",), ("10",), ("2A",), ("Konsiderans",), ("1",)])
    number = F.expr("try_cast(regexp_extract(article, '^[0-9]+', 0) as int)")
    return a.select("article", F.row_number().over(Window.orderBy(number.isNull(), number, "article")).alias("pos"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_worked_by_hand(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name])


CODES = {
    "open('a.txt','r+')": ["mode:r+"], "m = 'w'\nopen('x.txt', m)": ["mode:?"], "open('x.txt', mode='rb')": [], "import sys\nsys.exit(1)": ["attribute:sys.exit", "import:sys", "module:sys"],
    "x = os.path": ["attribute:os.path"], "def f(:": ["syntax"], "from .os import x": ["module:os"], "from . import x": ["module:"], "# never import os": ["import:os"], "import json, re as r": [],
    "import shutil\nshutil.rmtree('a')": ["call:shutil.rmtree", "module:shutil"], "p.rename('b')": ["method:rename"], "x = 'eval(1)'": [], "self.open('x.txt', 'w')": ["write_mode"], "import os.path as p": ["import:os", "module:os"],
    "a\x00b": ["syntax"], "os.system('ls')": ["attribute:os.system"], "print(getattr(a, 'b'))": ["call:getattr"],
}


def test_scan_of_syntax_trees(spark):
    rows = spark.createDataFrame(list(enumerate(CODES)), "i int, code string")
    got = {r.code: list(r.v) for r in rows.select("code", guard.violations(F.col("code")).alias("v")).collect()}
    assert got == CODES


def test_sections_named_by_article_number(spark):
    rows = [("a", 1, None, "Amar", "Membebaskan terdakwa"), ("b", 1, "", "amar", "Menolak"), ("c", 1, "Kepala", "Amar", "Menolak")]
    h = L.holdings(spark.createDataFrame(rows, "decision_id string, pos int, title string, article_number string, content string"))
    assert {r.decision_id: (r.terbukti, r.diksi) for r in h.collect()} == {"a": (False, ["membebaskan"]), "b": (None, ["menolak"]), "c": (None, None)}
