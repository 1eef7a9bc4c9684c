import hashlib
import random

import pytest
from pyspark.sql import functions as F

from codexmill.functions import legal as L
from codexmill.functions import text as X
from codexmill.operators import audit, graph, keyed, retrieval
from codexmill.sources import readers
from codexmill.streaming import streams


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks_of_all_edges(spark):
    def plain(t):
        return [p for i in range(0, len(t), 450) if (p := t[i : i + 500].strip())]

    texts = ["", "   ", "a" * 450, "a" * 451, "a" * 500, "a" * 501, "ab " * 400, "x" * 449 + " " + "y" * 60]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.chunks(F.col("t")).alias("c")).collect()
    assert {r.i: list(r.c) for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_rejoin_restores(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (10, 500, 900, 1400, 2711)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.t == r.again for r in df.select("t", X.rejoin(X.chunks(F.col("t"))).alias("again")).collect())


def test_budget_is_never_passed(spark):
    rng = random.Random(4)
    data = [(k, i, "z" * rng.randrange(0, 60)) for k in "ab" for i in range(20)]
    out = keyed.within_budget(spark.createDataFrame(data, "k string, i int, t string"), ["k"], ["i"], "t", 100).groupBy("k").agg(F.sum(F.length("t")).alias("n")).collect()
    assert all(r.n <= 100 for r in out) and len(out) == 2


def test_fusion_is_symmetric_and_absent_terms_score_nothing(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "query_id int, id int, rank int")
    assert rows(retrieval.fuse([a, b])) == rows(retrieval.fuse([b, a]))
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "gamma"), (2, "ALPHA")], "query_id int, text string")
    assert [(r.query_id, r.id) for r in retrieval.bm25(q, docs).collect()] == [(2, 1)]
    assert retrieval.bm25(q, docs.limit(0)).count() == 0


def test_cosine_range_and_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0], [-1.0, -2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] + 1) < 1e-12 and got[1] == 0.0


def test_rerank_reorders_only(spark):
    c = spark.createDataFrame([(1, "beta gamma", "alpha"), (2, "alpha beta", "alpha")], "id int, text string, query_text string")
    assert {r.id: r.rerank for r in retrieval.overlap_rerank(c).collect()} == {1: 0.0, 2: 1.0}


@pytest.mark.parametrize("edit", ["payload", "drop", "swap", "hash"])
def test_chain_finds_any_edit(spark, edit):
    data = [("k", i, f"p{i}") for i in range(12)]
    chain = [list(r) for r in audit.chain_append(spark.createDataFrame(data, "key string, seq long, payload string"), "key", "seq", "payload").orderBy("seq").collect()]
    prev = "0" * 64
    for r in chain:
        assert r[3] == prev and r[4] == hashlib.sha256(f"{prev}|{r[2]}".encode()).hexdigest()
        prev = r[4]
    if edit == "payload":
        chain[5][2] = "other"
    elif edit == "drop":
        del chain[5]
    elif edit == "swap":
        chain[5][1], chain[6][1] = chain[6][1], chain[5][1]
    else:
        chain[5][4] = "0" * 64
    r = audit.chain_verify(spark.createDataFrame([tuple(x) for x in chain], "key string, seq long, payload string, prev_hash string, entry_hash string"), "key", "seq", ["payload"]).first()
    assert r.n_valid == 5


def test_utc_text(spark):
    df = spark.sql("select timestamp'2024-05-01 10:00:00+02:00' a, timestamp'2024-05-01 08:00:00.000120+00:00' b")
    assert tuple(df.select(audit.utc_text(F.col("a")), audit.utc_text(F.col("b"))).first()) == ("2024-05-01T08:00:00+00:00", "2024-05-01T08:00:00.000120+00:00")


def test_isolation_without_edges(spark):
    n = spark.createDataFrame([(1,), (2,)], "k int")
    e = spark.createDataFrame([(1, 1)], "a int, b int")
    assert rows(graph.isolated(n, e, "k")) == [(2,)] and rows(graph.isolated(n, e.limit(0), "k")) == []


def test_first_match_and_upsert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    delta = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, ver int")
    assert rows(keyed.upsert(base, delta, ["k"], "ver").select("k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(keyed.insert_if_absent(base, delta, ["k"]).select("k", "v")) == [(1, "a"), (2, "b"), (3, "d")]


def test_nested_decisions_and_statutes(spark, tmp_path):
    spark.createDataFrame([("d", (["amar", "x"], ["y" * 70, "short"]))], "id string, paragraphs struct<tag:array<string>,value:array<string>>").write.parquet(f"{tmp_path}/d")
    assert rows(readers.decisions(spark, f"{tmp_path}/d")) == [("d", 0, "amar", "y" * 70)]
    laws = spark.createDataFrame([(1, "berlaku"), (2, "dicabut"), (3, "berlaku")], "id int, status string")
    arts = spark.createDataFrame([(i, 1, str(i), "t") for i in (3, 1, 2)] + [(9, 3, "1", "t")], "id int, law_id int, number string, text string")
    assert [(r.id, [a.number for a in r.articles]) for r in readers.statutes(laws, arts).collect()] == [(1, ["1", "2", "3"])]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x"}\nnot json\n')
    (tmp_path / "b.jsonl").write_text('{"q": "y"}\n')
    (tmp_path / "n.md").write_text("# T\nbody")
    got = readers.jsonl(spark, str(tmp_path), "q string")
    assert sorted((r.file, r.q) for r in got.collect() if r.q) == [("a.jsonl", "x"), ("b.jsonl", "y")] and got.count() == 3
    assert readers.jsonl(spark, str(tmp_path), "q string", "b.jsonl").count() == 1
    assert rows(readers.markdown(spark, str(tmp_path))) == [("n.md", "# T\nbody")]


def test_feed(spark):
    xml = "<rss><channel><item><title>a</title><link>u</link><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>"
    assert rows(readers.feed_items(spark.createDataFrame([(1, xml)], "id int, xml string"), "xml")) == [(1, "a", "u", "d")]


def test_index_manifest(spark, tmp_path):
    path = str(tmp_path / "index")
    assert readers.load_index(spark, path, 2) is None
    readers.save_index(retrieval.postings(spark.createDataFrame([(1, "alpha"), (2, "beta")], "doc_id int, text string")), path, 2)
    assert readers.load_index(spark, path, 2).count() == 2 and readers.load_index(spark, path, 3) is None


def test_read_only(spark):
    assert readers.read_only(spark, "select 1 as x -- drop\n").first().x == 1
    assert readers.read_only(spark, "select 'drop table' as x").first().x == "drop table"
    for bad in ("drop table t", "select 1; select 2", "insert into t values (1)", "with x as (select 1) insert into t select * from x"):
        with pytest.raises(ValueError):
            readers.read_only(spark, bad)


def test_first_source(spark):
    df = spark.createDataFrame([([], ["b"], None)], "a array<string>, b array<string>, c array<string>")
    assert df.select(readers.first_source(F.col("a"), F.col("c"), F.col("b"))).first()[0] == ["b"]


def test_incremental_import_is_idempotent(spark, tmp_path):
    sink, out = streams.import_new(str(tmp_path / "t"), "k"), str(tmp_path / "t")
    for part in ([(1,), (2,), (2,)], [(2,), (3,)], [(2,), (3,)]):
        sink(spark.createDataFrame(part, "k int"), 0)
    assert rows(spark.read.parquet(out)) == [(1,), (2,), (3,)]


def test_elements_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("tanpa delik",)], "t string")
    assert [r[0] for r in df.select(L.elements(F.col("t"))).collect()] == [None, None, None]


def test_knn_by_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)] + [(60, 5000.0, 5000.0)]
    got = {(r.k, r.other) for r in keyed.nearest_in_plane(spark.createDataFrame(pts, "k int, x double, y double"), "k", "x", "y", 3, 5.0).collect()}
    want = {(a, b) for a, x, y in pts for b, *_ in sorted(((p[0], (p[1] - x) ** 2 + (p[2] - y) ** 2) for p in pts if p[0] != a), key=lambda p: (p[1], p[0]))[:3]}
    assert got == want


def test_embed_prefixes_and_nulls(spark):
    """The kind's prefix is embedded with the text; a null text is the prefix alone."""
    from codexmill.operators import retrieval as R

    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    for kind, prefix in R.PREFIXES.items():
        got = {r.id: list(r.vector) for r in R.embed(rows, kind).collect()}
        for i, text in ((1, prefix + "a b"), (2, prefix)):
            counts = [0] * 64
            for word in text.split():
                counts[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1
            assert got[i] == [c / sum(n * n for n in counts) ** 0.5 for c in counts]


def test_rising_times_by_loop(spark):
    """Equal and earlier times move on by one microsecond, as one entry after the other would."""
    from pyspark.sql import functions as F

    from codexmill.operators import audit

    us = [5, 5, 5, 3, 20, 7, 21, 21]
    rows = spark.createDataFrame([("k", i, u) for i, u in enumerate(us)], "k string, i int, us long")
    got = [r.t for r in rows.select("i", audit.rising(F.timestamp_micros("us"), "k", "i").alias("t")).orderBy("i").collect()]
    want, last = [], -1
    for u in us:
        last = max(u, last + 1)
        want.append(last)
    assert got == want
