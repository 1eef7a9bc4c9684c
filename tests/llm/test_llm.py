"""Every dealt operator against a brute-force version, on rows of all odd kinds and on the driver's smallest tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codexmill.llm import byte_bpe, decontaminate, image_copies, jaccard_join, language_id, line_dedup, ppm_score, queries, sharding, token_store, url_filter
from oracle import SF, same

P = pytest.importorskip("public_tokenizers")
RANKS, PATTERN, WORD_BPE = P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    vocab = ["alpha", "Beta", "gamma,", "delta.", "don't", "café", "naïve", "x", "42nd", "straße", "日本", "q_r"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    base = say(120)
    near = base.split()
    near[5] = "changed"
    return [
        (1, base), (2, None), (3, ""), (4, " \t\n \x0b"), (5, base), (5, base), (None, base), (None, None), (6, " ".join(near)), (7, base.upper()),
        (8, "one two"), (9, "one two"), (10, say(4000)), (11, "a" * 3000), (12, "line\nLINE \n\nother"), (13, "1234 !!"), (14, "tab\tsep\r\nend <|endoftext|> x|y"), (-3, say(30)), (15, "e\u0301 I\u0307 " * 3),
    ]


def frame(spark, rows, clash="row"):
    """``rows`` with a column whose name an operator might use itself."""
    return spark.createDataFrame([(i, t, f"{n}") for n, (i, t) in enumerate(rows)], f"doc_id long, text string, {clash} string")


def by_row(df, clash="row"):
    return {int(r[clash]): r for r in df.collect()}


def small(spark, n=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)[:n]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_registered():
    names = __spark_entry__.queries().keys()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)} and set(queries.QUERIES) <= names


# ---- 1

def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/7?x#y", "https://example.com/en/8", "x://net/de/1", "ftp://b.example.net/de/88", "example.com/en/7", None, "", "http://", "http://notcom/en/", "http://a.org#/es/", "http://h?u=http://b.com/en/", "http://a.com/en/\nz"]
    pages = spark.createDataFrame([(i, u, None, "kept") for i, u in enumerate(urls)], "page_id long, url string, good int, n string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge_urls(pages, queries.RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/7", "example.com/en/7"), 1: ("example.com", "/en/8", "com/en/"), 2: ("net", "/de/1", "net/de/"), 3: ("b.example.net", "/de/88", "example.net/de/8"),
        4: ("", "", None), 5: ("", "", None), 6: ("", "", None), 7: ("", "", None), 8: ("notcom", "/en/", None), 9: ("a.org", "", None), 10: ("h", "", None), 11: ("a.com", "/en/\nz", "com/en/"),
    }
    assert url_filter.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_reputation_shrinks(spark):
    rows = [("good.a.com", 1)] * 60 + [("bad.b.com", 0)] * 60 + [("new.a.com", None), ("new.b.com", None), ("once.b.com", 1)] + [("c.a.com", 1)] * 20 + [("d.b.com", 0)] * 20
    out = {r.host: r.bound for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, good int")).collect()}
    assert out["good.a.com"] > 0.8 > 0.5 > out["bad.b.com"] and out["new.a.com"] > out["new.b.com"] and out["once.b.com"] < 0.5


def test_reputation_levels(spark):
    """Port and user info are no part of a level; domains of a country's second level are apart; an address is its own domain."""
    dots = [tuple(r) for r in spark.createDataFrame([("a.example.com.",), ("b.other.com.:80",), (".",)], "h string").select(url_filter.registered_domain(url_filter.site_of(F.col("h"))), url_filter.suffix(url_filter.site_of(F.col("h")))).collect()]
    assert dots == [("example.com", "com"), ("other.com", "com"), ("", "")]
    hosts = ["a.co.uk", "x.a.co.uk:80", "u@b.co.uk", "b.com", "1.2.3.4:8", "co.uk", "", "[::1]:5", "w.b.com\n"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "i int, h string")
    site = url_filter.site_of(F.col("h"))
    got = [tuple(r)[1:] for r in rows.select("i", site, url_filter.registered_domain(site), url_filter.suffix(site)).orderBy("i").collect()]
    assert got == [("a.co.uk", "a.co.uk", "co.uk"), ("x.a.co.uk", "a.co.uk", "co.uk"), ("b.co.uk", "b.co.uk", "co.uk"), ("b.com", "b.com", "com"), ("1.2.3.4", "1.2.3.4", ""), ("co.uk", "co.uk", "co.uk"), ("", "", ""), ("[::1]", "[::1]", "[::1]"), ("w.b.com\n", "b.com\n", "com\n")]
    good = [("g.a.co.uk", 1)] * 50 + [("h.b.co.uk", 0)] * 50 + [("new.a.co.uk:8080", None), ("new.b.co.uk", None)]
    bound = {r.host: r.bound for r in url_filter.host_reputation(spark.createDataFrame(good, "host string, good int")).collect()}
    assert bound["new.a.co.uk"] > bound["new.b.co.uk"]


def test_rules_by_brute_force(spark, monkeypatch):
    """Rules as expressions and as a table against a loop: equal lengths, repeated rules and pages, nulls, many labels, empty rule hosts and paths."""
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice(["a", "b", "com", "c"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "x", "y"]) for _ in range(rng.randint(0, 4)))
    rules = [url_filter.Rule(rng.choice(["allow", "block"]), host(), path()) for _ in range(120)]
    rules += rules[:5] + [url_filter.Rule("block", rules[0].host, rules[0].path), url_filter.Rule("allow", "", "/x")]
    urls = [f"http://{host()}/{path()}" for _ in range(300)] + [None, "", "http://", "http:///x", "http://" + "a." * 50 + "com/x/"]
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, None, i) for i, u in enumerate(urls)], "page_id long, url string, good int, _hit long")

    def wanted(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.split(r"[/?#]", rest, maxsplit=1)[0]
        p = rest[len(h):]
        fits = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return (best.host + best.path, best.verdict) if best else (None, "block")

    for most in (10**6, 0):
        monkeypatch.setattr(url_filter, "EXPRESSION_RULES", most)
        got = {r.page_id: (r.rule, r.verdict, r._hit) for r in url_filter.judge_urls(pages, rules, min_rate=2.0).collect()}
        assert got == {i: (*wanted(u), i) for i, u in enumerate(urls)}


# ---- 2

def texture(seed, side=96):
    rng = np.random.default_rng(seed)
    coarse = rng.uniform(0, 255, (side // 6, side // 6))
    img = np.kron(coarse, np.ones((6, 6)))
    return ((img + np.roll(img, 1, 0) + np.roll(img, 1, 1) + np.roll(img, 2, 0)) / 4).clip(0, 255)


def test_crops_edits_and_turns_are_found(spark):
    base, other = texture(1), texture(2)
    edited = base.copy()
    edited[:30, :30] = 128
    images = [(1, base), (2, base[8:, 10:]), (3, base * 0.7 + 30), (4, edited), (5, np.rot90(base)), (6, other), (7, other[:, 6:]), (8, texture(3)), (9, base)]
    rows = [(i, x.round().astype(np.uint8).tobytes(), x.shape[1], x.shape[0], "z") for i, x in images]
    rows += [(10, None, 5, 5, None), (11, b"", 0, 0, None), (12, b"abc", 9, 9, None), (None, rows[7][1], 96, 96, None), (13, bytes(96 * 96), 96, 96, None)]
    df = spark.createDataFrame(rows, "id long, pixels binary, width int, height int, img string")
    got = {(r.id, r.group_id) for r in image_copies.copy_groups(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (9, 1), (6, 6), (7, 6), (8, 8), (None, 8), (10, 10), (11, 11), (12, 12), (13, 13)}
    assert image_copies.copy_groups(df.limit(0)).count() == 0


def test_votes_of_a_pair_add_up_over_all_lists(spark):
    """Two copies share half their corners' lists with a lesser image; against all pairs of images."""
    rng = np.random.default_rng(4)
    words, spot = rng.integers(0, 2**63, (10, 4), np.uint64), rng.uniform(0, 90, (3, 10, 2))
    spot[2] = spot[1] + 3
    # Image 1 has the descriptors of five corners of 2 and 3 at other places; image 4 none of them.
    every = {}
    for img, n in ((1, 5), (2, 10), (3, 10), (4, 10)):
        own = np.zeros(n, image_copies.CORNER)
        own["d"], own["x"], own["y"], own["scale"] = words[:n] if img < 4 else ~words, *spot[(img - 1) % 3, :n].T, 1
        every[img] = own
    brute = {(a, b) for a in every for b in every if a < b and image_copies.agreeing(every[a], every[b]) >= image_copies.AGREEING}
    assert brute == {(2, 3)}
    found = spark.createDataFrame([(i, len(c), c.tobytes()) for i, c in every.items()], "img long, n long, corners binary")
    assert {tuple(r) for r in image_copies.copy_links(found).collect()} == {(2, 2), (3, 2)}


def test_groups_of_edits_by_brute_force(spark):
    """All pairs of corners of all pairs of images, and the recall of each kind of edit."""
    rng = np.random.default_rng(12)
    bases = [texture(40 + i, 160) for i in range(8)]
    edits = [lambda x: x[30:120, 40:140], lambda x: x + rng.normal(0, 10, x.shape), lambda x: x * 0.6 + 20, lambda x: resampled(x, 112, turn=10),
             lambda x: resampled(x, 112, turn=45), lambda x: resampled(x, 128, size=0.8), lambda x: resampled(x, 80, size=0.5), lambda x: (x + np.roll(x, 1, 0) + np.roll(x, 1, 1)) / 3]
    images = [(100 * k + j, x.round().clip(0, 255).astype(np.uint8)) for k, base in enumerate(bases) for j, x in enumerate([base, *[e(base) for e in edits]])]
    rows = [(i, x.tobytes(), x.shape[1], x.shape[0]) for i, x in images]
    found = {i: image_copies.corners_of(x[None].astype(float))[0] for i, x in images}
    got = {r.id: (r.n_corners, r.group_id) for r in image_copies.copy_groups(spark.createDataFrame(rows, "id long, pixels binary, width int, height int")).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(c) for i, c in found.items()}
    group = {i: i for i in found}
    for a in found:
        for b in found:
            if a < b and (a // 100 == b // 100 or (a % 100 < 2 and b % 100 < 2)) and image_copies.agreeing(found[a], found[b]) >= image_copies.AGREEING:
                least = min(group[a], group[b])
                group = {i: least if g in (group[a], group[b]) else g for i, g in group.items()}
    assert all(group[i] == i // 100 * 100 for i in found)  # no false link, none missed, by brute force
    right = [got[i][1] == group[i] for i in found]
    assert sum(right) >= 0.97 * len(right) and all(got[i][1] // 100 == i // 100 for i in found)


def resampled(img, side, turn=0.0, size=1.0):
    """``side`` by ``side`` pixels around the centre of ``img``, turned by degrees and scaled."""
    cos, sin = math.cos(math.radians(turn)) / size, math.sin(math.radians(turn)) / size
    total = 0
    for dy, dx in ((-0.25, -0.25), (-0.25, 0.25), (0.25, -0.25), (0.25, 0.25)):
        y, x = np.meshgrid(np.arange(side) + dy - (side - 1) / 2, np.arange(side) + dx - (side - 1) / 2, indexing="ij")
        sx, sy = cos * x - sin * y + (img.shape[1] - 1) / 2, sin * x + cos * y + (img.shape[0] - 1) / 2
        x0, y0 = np.clip(np.floor(sx).astype(int), 0, img.shape[1] - 2), np.clip(np.floor(sy).astype(int), 0, img.shape[0] - 2)
        fx, fy = np.clip(sx - x0, 0, 1), np.clip(sy - y0, 0, 1)
        total = total + (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy
    return total / 4


def test_small_crops_sizes_turns_and_noise_are_found(spark):
    rng = np.random.default_rng(9)
    big, base, other = texture(5, 384), texture(1, 192), texture(2, 192)
    images = [(1, big), (2, big[60:156, 100:196]), (3, base), (4, base[40:136, 70:166]), (5, resampled(base, 134, size=0.7)), (6, resampled(base, 163, size=0.85)),
              (7, resampled(base, 134, turn=10)), (8, base + rng.normal(0, 12, base.shape)), (9, other), (10, resampled(other, 96, size=0.5)), (11, texture(3, 192))]
    rows = [(i, x.round().clip(0, 255).astype(np.uint8).tobytes(), x.shape[1], x.shape[0]) for i, x in images]
    df = spark.createDataFrame(rows, "id long, pixels binary, width int, height int")
    got = {r.id: r.group_id for r in image_copies.copy_groups(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, 9: 9, 10: 9, 11: 11}


def test_keys_of_tables():
    """Descriptors meet in a table exactly if they agree in its bits."""
    rng = np.random.default_rng(1)
    one = np.zeros(40, image_copies.CORNER)
    one["d"] = rng.integers(0, 2**63, 4, np.uint64)
    flips = np.zeros((40, 256), np.uint8)
    for i in range(40):
        flips[i, rng.permutation(256)[: i // 2]] = 1
    one["d"] ^= np.packbits(flips, axis=1, bitorder="little").view("<u8")
    keys = image_copies.table_keys(one)
    assert keys.shape == (40, image_copies.TABLES)
    for t, chosen in enumerate(image_copies.CHOSEN):
        assert ((keys[:, t] == keys[0, t]) == (flips[:, chosen].sum(1) == 0)).all()


# ---- 3

def test_codes_round_trip_and_random_access():
    rng = random.Random(2)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], [rng.choice([1, 300, 70000, 2**25]) for _ in range(3000)]):
        a = np.array(ids, np.uint32)
        levels, bits, ranks = token_store.pack(a)
        assert token_store.unpack(levels, bits).tolist() == ids
        assert [token_store.token(levels, bits, ranks, i) for i in range(len(ids))] == ids


def test_store(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    rows = odd_texts() + small(spark)
    token_store.write_tokens(frame(spark, rows, "part"), f"{tmp_path}/s", WORD_BPE, 2, segment_tokens=500, parts=5)
    got = sorted(token_store.read_documents(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    encoded = Counter((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == encoded
    ids = [x for r in got for x in r.ids]
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    asked = [0, 1, len(ids) - 1, len(ids), -1, len(ids) // 2, len(ids) // 3]
    found = token_store.tokens_at(spark, f"{tmp_path}/s", spark.createDataFrame([(p,) for p in asked], "position long")).collect()
    assert {r.position: r.token_id for r in found} == {p: ids[p] if 0 <= p < len(ids) else None for p in asked}
    clashing = spark.createDataFrame([(p, 1, 2, "l", -5, 7, 8) for p in [*range(len(ids)), 3, None]], "at long, start long, `end` long, levels string, _p long, token_id long, position long")
    found = token_store.tokens_at(spark, f"{tmp_path}/s", clashing, "at").collect()
    assert Counter((r["at"], r.token_id) for r in found) == Counter([*enumerate(ids), (3, ids[3]), (None, None)]) and {(r.start, r.end, r.levels, r._p, r.position) for r in found} == {(1, 2, "l", -5, 8)}


def test_ids_by_word_on_random_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(WORD_BPE), random.Random(5)
    parts = list("aabBcIİKéÉöÖßſŉǰ'’stredlvm.,!&*$%()[]{}|<>-_=+#@~`^0123²½٣ \t\n\r\v\f\x1c\x85\u00a0\u3000\u0338\u0301\u0307\u200b日本한ẞﬁÅΣς")
    texts = [None, ""] + ["".join(rng.choices(parts + ["'s", "'LL", " <|endoftext|>", "...", "ö.", "é,", "İ.", "ñ!?"], k=rng.randrange(40))) for _ in range(8000)]
    for memo, group in ((800_000, 8_000_000), (150, 2000)):
        own = token_store.Words(WORD_BPE)
        assert own.by_word
        token_store.MEMO_ENTRIES, token_store.GROUP_BYTES, before = memo, group, (token_store.MEMO_ENTRIES, token_store.GROUP_BYTES)
        got = list(own.encode(pa.array([*texts, " ".join(t or "" for t in texts)], pa.string())))
        token_store.MEMO_ENTRIES, token_store.GROUP_BYTES = before
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts] + [tok.encode(" ".join(t or "" for t in texts), add_special_tokens=False).ids]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_other_tokenizers_get_whole_texts():
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(WORD_BPE).to_str())
    assert token_store.splits_at_space(spec)
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"post_processor": {"type": "ByteLevel"}}):
        assert not token_store.splits_at_space(spec | change)
    own = token_store.Words(WORD_BPE)
    own.by_word = False
    assert [len(x) for x in own.encode(pa.array(["Two words", None, ""]))] == [4 * len(own.tokenizer.encode("Two words").ids), 0, 0]


def test_store_of_nothing(spark, tmp_path):
    token_store.write_tokens(frame(spark, odd_texts()).limit(0), f"{tmp_path}/s", WORD_BPE, 2)
    assert token_store.read_documents(spark, f"{tmp_path}/s").count() == 0


# ---- 4

def test_language_model_score(spark):
    rows = odd_texts() + small(spark, 25)
    docs = frame(spark, rows, "word")
    held = [n % 5 == 0 for n in range(len(rows))]
    model, counts = brute.Ppm(ppm_score.ORDER), Counter()
    whole = lambda t: b"\n" * ppm_score.ORDER + " ".join(brute.words(t)).encode() + b"\n"
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            model.learn(whole(t))
            counts.update([*brute.words(t), "\n"])
    n, v = counts.total(), len(counts)
    for blocks, head in ((10**9, 10**6), (400, 20)):
        got = by_row(ppm_score.score(docs, docs.where("cast(word as int) % 5 <> 0"), block_grams=blocks, head_words=head), "word")
        assert len(got) == len(rows)
        for k, (_, t) in enumerate(rows):
            tokens, r = [*brute.words(t), "\n"], got[k]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(x in counts for x in tokens), n)
            assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9)
            assert math.isclose(r.score, model.log2(whole(t), True) * math.log10(2), rel_tol=1e-4)


def test_language_model_learns(spark):
    """Held-out code lengths shrink as the training documents grow."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("part", F.col("doc_id") % 10)
    few, many = (ppm_score.score(docs.where("part = 0"), docs.where(f"part between 1 and {n}")).agg(F.sum("score")).first()[0] for n in (1, 9))
    assert many > few


def test_language_model_without_training(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm_score.score(docs, docs.limit(0)).collect()}
    assert math.isclose(got[1].score, -3 * math.log10(256), rel_tol=1e-5) and (got[1].n_known, got[1].train_tokens) == (0, 0) and got[2].n_tokens == 1
    assert ppm_score.score(docs.limit(0), docs).count() == 0


# ---- 5

def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark):
    own, rows = library(), odd_texts() + small(spark)
    got = by_row(byte_bpe.decode(byte_bpe.encode(frame(spark, rows, "ids2"), RANKS, PATTERN), RANKS, PATTERN), "ids2")
    digests = by_row(byte_bpe.round_trip(frame(spark, rows, "n"), RANKS, PATTERN), "n")
    assert len(got) == len(rows)
    for k, (_, t) in enumerate(rows):
        ids = own.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(got[k].ids) == raw and got[k].n_tokens == len(ids) and bytes(got[k].decoded) == (t or "").encode()
        assert (digests[k].ids_sha256, digests[k].decoded_sha256) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_segment_tree_on_random_pieces():
    own, codec, rng = library(), byte_bpe.codec(RANKS, PATTERN), random.Random(3)
    for _ in range(300):
        piece = "".join(rng.choice("abeinrst") for _ in range(rng.choice([1, 2, 5, 17, 70, 400])))
        want = own.encode_ordinary(piece)
        assert byte_bpe.merge_piece(piece.encode(), codec.ranks) == want


# ---- 6

def test_shards(spark):
    rng = random.Random(4)
    rows = odd_texts() + [(100 + i, "word " * rng.randrange(1, 60)) for i in range(3000)] + [(9000 + i, "hot text " * 5) for i in range(1500)]
    docs = frame(spark, rows, "_range")
    out = sharding.shard_by_bytes(docs, 16, ranges_per_shard=8).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for s in range(16):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= 0.15 * total / 16 + largest
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    assert sharding.shard_by_bytes(docs.limit(0), 16).count() == 0


def test_only_a_large_text_is_split_among_shards(spark):
    rng = random.Random(6)
    rows = [(i, f"text {i // 2} " + "x" * rng.randrange(200)) for i in range(0, 1200, 2) for _ in range(1)]
    rows += [(i + 1, t) for i, t in rows]  # each text twice
    rows += [(5000 + i, "copied " * 20) for i in range(700)]
    got = sharding.shard_by_bytes(frame(spark, rows), 8, ranges_per_shard=16).collect()
    assert len(got) == len(rows)
    shards, where = {}, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    total = sum(r.size for r in got)
    assert sorted(shards) == list(range(8))
    for rs in shards.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 8) < 0.2 * total / 8
    assert sum(len(x) > 1 for x in where.values()) == 1
    whole = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert all((r.size, r.text_crc32) == whole[r.doc_id] for r in got)


def test_scores_with_clashing_columns(spark):
    names = ["_k1", "_k2", "part", "doc", "word", "n", "score", "head_known"]
    df = spark.createDataFrame([(i, f"some words {i}", *[f"{c}{i}" for c in names]) for i in range(5)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = ppm_score.score(df, df).collect()
    assert len(got) == 5 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names if c != "score") and all(r.score < 0 for r in got)


def test_duplicates_with_clashing_columns(spark):
    names = ["_row", "row", "one", "_one", "_text", "doc", "c", "g", "n", "id"]
    df = spark.createDataFrame([(i, "one two three four five six seven", *[f"{c}{i}" for c in names]) for i in range(4)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    (r,) = jaccard_join.deduplicate(df).collect()
    assert r.doc_id == 0 and all(r[c] == f"{c}0" for c in names)


# ---- 7

@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, k, percent):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(40)]
    rows = odd_texts()
    for g in range(12):
        base = rng.choices(vocab, k=rng.randrange(3, 90))
        for _ in range(rng.randrange(1, 14)):  # copies of a text and copies of copies
            rows.append((len(rows) * 7 % 1000 + 50, " ".join(base)))
            base = list(base) if rng.random() < 0.5 else base
            base[rng.randrange(len(base))] = rng.choice(vocab)
    rows += small(spark, 120)
    component, n = brute.components(rows, k, percent)
    least = {}
    for c, (i, _) in zip(component, rows, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), k=k, percent=percent).collect())
    assert got == Counter((i, m, least.get(c) if m else i) for (i, _), m, c in zip(rows, n, component, strict=True))
    kept = jaccard_join.deduplicate(frame(spark, rows), k=k, percent=percent)
    assert kept.columns == ["doc_id", "text", "row"]
    left = [int(r.row) for r in kept.collect()]
    assert sorted(component[x] for x in left if n[x]) == sorted({c for c, m in zip(component, n, strict=True) if m})
    assert sorted(x for x in left if not n[x]) == [x for x, m in enumerate(n) if not m]
    assert all(rows[x][0] == least.get(component[x]) for x in left if n[x])


def test_jaccard_of_nothing(spark):
    none = frame(spark, odd_texts()).limit(0)
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.deduplicate(none).count() == 0


# ---- 8

def test_language_by_brute_force(spark):
    rows = [(t, "aa") for t in ("der hund und die katze", "das ist nicht gut", "ein mann")] + [(t, "bb") for t in ("the dog and the cat", "this is not good", "a man")] + [(None, "aa"), ("x", None)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    plain = {}
    for t, lang in rows:
        if t and lang:
            plain.setdefault(lang, brute.Ppm(language_id.ORDER)).learn(language_id.prepared(t))
    asked = ["the man and the dog", "die katze ist gut", "", None, "123 !", "xyz q", "THE CAT" * 50]
    docs = spark.createDataFrame([(i, t, 5.0) for i, t in enumerate(asked)], "doc_id long, text string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    for i, t in enumerate(asked):
        if not t or i == 4:
            assert got[i] == ("und", 0.0)
            continue
        bits = {k: m.log2(language_id.prepared(t), False) for k, m in plain.items()}
        best = max(bits, key=bits.get)
        assert got[i][0] == best and math.isclose(got[i][1], 1 / sum(2 ** (b - bits[best]) for b in bits.values()), rel_tol=1e-3)
    nothing = language_id.train(docs.select("text", F.lit("x").alias("lang")).limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_accuracy_on_held_out(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null").select("doc_id", "lang")
    r = queries.op8_language_id(spark, SF).where("held_out and lang_pred <> 'und'").join(langs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r.a >= 0.9


# ---- 9

@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination(spark, block_chars):
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices(["a1", "Be", "ça", "d", "e", "f9", "g", "h-h"], k=n))
    items = [(1, say(30)), (2, say(13)), (3, say(12)), (4, "d"), (5, None), (None, say(20)), (6, ""), (7, "!!"), (2, say(14))]
    rows = odd_texts() + [(50 + i, say(rng.randrange(40))) for i in range(20)] + [(90, f"{say(9)} {items[0][1].upper()} {say(7)}"), (91, items[1][1].replace(" ", "\n? ")), (92, say(700) + " " + items[0][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, hits int")
    got = by_row(decontaminate.find_contamination(frame(spark, rows), bench, block_chars=block_chars))
    for k, (n, hit, names) in enumerate(brute.contamination([t for _, t in rows], items)):
        r = got[k]
        assert (r.n_words, r.n_hit, r["items"], r.n_items, r.contaminated) == (n, hit, names, len(names), hit > 0 and 20 * hit >= n)
        if r.spans:  # the spans hold the words
            low = decontaminate.lowered(rows[k][1])
            assert sum(len(decontaminate.WORD.findall(low[s.start : s.end])) for s in r.spans) == hit
    assert all(not r.contaminated for r in decontaminate.find_contamination(frame(spark, rows), bench.limit(0)).collect())
    assert decontaminate.find_contamination(frame(spark, rows).limit(0), bench).count() == 0


# ---- 10

@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    rng = random.Random(7)
    pool = ["Menu", " menu\t", "MENU", "", "  ", "Straße", "STRASSE", "x"] + [f"line {i}" for i in range(12)]
    rows = odd_texts() + [(100 + i // 2, "\n".join(rng.choices(pool, k=rng.randrange(9)))) for i in range(60)]
    got = by_row(line_dedup.dedup_lines(frame(spark, rows, "h1"), batches=batches, fanout=fanout), "h1")
    for k, (lines, kept) in enumerate(brute.kept_lines([t for _, t in rows])):
        assert (got[k].n_lines, got[k].n_dropped, got[k].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_lines_with_clashing_columns(spark):
    names = ["k1", "k2", "hot", "doc", "whole", "at", "h", "h1", "h2", "n", "batch", "_k1", "_hot", "n_lines", "kept_text"]
    rows = [(i, "menu\nown %d" % i, *[f"{c}{i}" for c in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    for r in line_dedup.dedup_lines(df).collect():
        assert (r.n_lines, r.n_dropped, r.kept_text) == (2, 1, f"own {r.doc_id}")
        assert all(r[c] == f"{c}{r.doc_id}" for c in names if c not in ("n_lines", "kept_text"))


def test_a_new_batch_of_lines_reads_the_runs(spark):
    texts = [f"a\nb{i % 3}\nc{i}" for i in range(30)]
    df = frame(spark, list(enumerate(texts))).repartition(3)
    runs = line_dedup.LineRuns(spark, min_docs=10, fanout=3, buckets=4)
    wanted = lambda n: {line for line in {x for t in texts for x in t.split("\n")} if sum(line in t.split("\n") for t in texts[:n]) >= 10}
    hashes = lambda lines: {tuple(r.h) for r in spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup.key_hash("x").alias("h")).collect()} if lines else set()
    for upto in (6, 12, 18, 24, 30):
        runs.add(df.where(f"doc_id >= {upto - 6} and doc_id < {upto}"))
        assert {(r.h1, r.h2) for r in runs.frequent_keys().collect()} == hashes(wanted(upto))
    assert [len(level) for level in runs.levels] == [2, 1]
    # Joined with the runs, a batch is neither shuffled nor sorted.
    one, two = (spark.table(r) for r in runs.levels[0])
    with runs.merging():
        plan = one.join(two.where("n >= 10").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


def test_a_text_of_very_many_lines(spark):
    rows = [(i, "\n".join(f"l{j}" for j in range(60_000))) for i in range(10)] + [(10, "\n".join(["l1", "own"] * 100_000))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert all((got[i].n_dropped, got[i].kept_text) == (60_000, "") for i in range(10))
    assert (got[10].n_lines, got[10].n_dropped, got[10].kept_text) == (200_000, 100_000, "\n".join(["own"] * 100_000))


# ---- the pipeline

def test_pipeline_by_stage(spark, tmp_path):
    import corpus_pipeline as C

    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found[name] = [(r.doc_id, getattr(r, "text", None)) for r in docs.collect()]
        if name != C.STAGES[-1][0]:
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in C.STAGES] == list(found)
    before = found["language_id"]
    assert {i for i, _ in before} <= {i for i, _ in small(spark)}
    assert sorted(found["line_dedup"]) == sorted((i, "\n".join(kept)) for (i, _), (_, kept) in zip(before, brute.kept_lines([t for _, t in before]), strict=True))
    rows = sorted(found["line_dedup"])
    component, n = brute.components(rows, 5, 80)
    first = {}
    for (i, _), c in zip(rows, component, strict=True):
        first.setdefault(c, i)
    assert sorted(found["jaccard_join"]) == sorted(r for r, c, m in zip(rows, component, n, strict=True) if not m or r[0] == first[c])
    rows = found["jaccard_join"]
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    marks = brute.contamination([t for _, t in rows], items)
    assert sorted(found["decontaminate"]) == sorted(r for r, (w, hit, _) in zip(rows, marks, strict=True) if not (hit and 20 * hit >= w))
    own = library()
    last = {r.doc_id: r for r in docs.collect()}
    assert len(last) == len(found["decontaminate"])
    for i, t in found["decontaminate"]:
        ids = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        assert (last[i].n_tokens, last[i].ids_sha256, last[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
