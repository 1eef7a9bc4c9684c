"""Phrases, vector codes and secrets against plain versions, on odd rows and on the driver's smallest tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from codexmill.llm import collocations, secret_scan, vector_codes
from codexmill.llm.secret_scan import ADDED, BASE, SecretRule

from oracle import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11

def gram_counts(rows, max_words):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, max_words + 1):
                for i in range(len(w) - n + 1):
                    f[lang or "und"][tuple(w[i : i + n])] += 1
    return f


def phrases(rows, max_words, least, percent, top):
    out = set()
    for lang, f in gram_counts(rows, max_words).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= percent * a and inside(g, h) for h, b in cand.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, left, right, n, score))
        for rank, (_, _, phrase, *rest) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, phrase.decode(), *rest))
    return out


def speech(seed, n=60):
    rng = random.Random(seed)
    vocab = "new york city of the Big apple, a. b naïve Ünder 日本 x:y z\tq w\x0bv".split(" ")
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for _ in range(n)]
    return [*rows, *rows[:9], ("en", None), ("de", ""), (None, "\n .. "), ("fr", "a b " * 400), ("en", "New York City " * 200 + "new york!"), ("xx", "é" * 5000)]


@pytest.mark.parametrize(("max_words", "least", "percent", "top"), [(5, 4, 100, 2000), (3, 3, 60, 7), (2, 2, 100, 50), (7, 10, 100, 2000)])
def test_phrases_by_brute_force(spark, max_words, least, percent, top):
    rows = speech(max_words)
    docs = spark.createDataFrame([(a, b, "1", "p") for a, b in rows], "lang string, text string, f string, phrase string").repartition(5)
    got = [tuple(r) for r in collocations.collocations(docs, max_words=max_words, min_count=least, covered_percent=percent, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == phrases(rows, max_words, least, percent, top) != set()


def test_phrases_of_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations.collocations(docs).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    """A text many times longer than a buffer gives the grams of the whole, each once."""
    monkeypatch.setattr(collocations, "BUFFER", 200)
    rng = random.Random(5)
    text = " ".join(rng.choices(["aa", "B", "cc.", "d,", "e" * 90, "  ", "日本"], k=900)) + " "
    batch = pa.record_batch([pa.array(["en", "en", None]), pa.array([text, None, "q r"])], ["lang", "text"])
    got = Counter()
    for out in collocations.short_grams(iter([batch.set_column(0, "lang", batch.column(0).fill_null("und"))])):
        for lang, phrase, f in zip(*[c.to_pylist() for c in out.columns], strict=True):
            got[lang, phrase] += f
    want = Counter()
    for lang, f in gram_counts([("en", text), (None, "q r")], 2).items():
        want[lang, ""] = sum(c for g, c in f.items() if len(g) == 1)
        want.update({(lang, " ".join(g)): c for g, c in f.items()})
    assert got == want


def test_scores_pass_64_bits(spark):
    """The product of counts is taken in decimals."""
    n = spark.sql("select (1000 * (cast(90000000000 as decimal(19,0)) * cast(900000000000000 as decimal(16,0)))) div (cast(90000000000 as decimal(19,0)) * cast(80000000000 as decimal(19,0))) as s").first().s
    assert n == 1000 * 900000000000000 // 80000000000


# ---- 12

def codes(rows, parts, entries, rounds, scale=1024):
    """``{row number: (code, error)}`` and the codebooks, in plain integers."""
    kept = {n: [int(np.floor(float(v) * scale)) for v in x] for n, (_, x, _) in enumerate(rows) if x is not None and all(v is not None and np.isfinite(v) for v in x)}
    order = sorted(kept, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, kept[n]))
    step = len(next(iter(kept.values()))) // parts
    cut = {n: [tuple(x[p * step : (p + 1) * step]) for p in range(parts)] for n, x in kept.items()}
    books = [[cut[n][p] for n in order[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((away(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            mine = defaultdict(list)
            for n in cut:
                mine[near(p, cut[n][p])[1]].append(cut[n][p])
            for i, found in mine.items():
                new[p][i] = tuple(sum(c) // len(found) for c in zip(*found, strict=True))
        books = new
    best = {n: [near(p, x[p]) for p in range(parts)] for n, x in cut.items()}
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {n: ("".join(f"{i:02x}" for _, i in b), sum(d for d, _ in b)) for n, b in best.items()}, digest


def vectors(n, width, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 3) for _ in range(width)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]
    bad = [(900, None, 1), (901, [None] + [0.0] * (width - 1), 1), (902, [float("nan")] * width, 2), (903, [float("inf")] * width, None), (904, [0.0] * (width - 1) + [float("-inf")], 3)]
    rows += [*bad, (None, [0.5] * width, 3), (None, [-0.5] * width, 3), *rows[:8], (3, [9.0] * width, None), (5, [-0.0005] * width, 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "width", "parts", "entries", "rounds"), [(150, 8, 4, 16, 3), (60, 8, 2, 256, 4), (40, 3, 1, 5, 0), (7, 4, 4, 256, 2)])
def test_codes_by_brute_force(spark, n, width, parts, entries, rounds):
    rows = vectors(n, width, n)
    table = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, id int, code string").repartition(3)
    want, digest = codes(rows, parts, entries, rounds)
    got = vector_codes.vector_codes(table, parts, entries, rounds).collect()
    assert sorted((repr(r.vec_id), r.code, r.error) for r in got) == sorted((repr(rows[i][0]), *w) for i, w in want.items())
    assert {r.codebooks_sha256 for r in got} == {digest}
    total = Counter()
    for i, (_, error) in want.items():
        total[rows[i][2]] += error
    assert sorted(r.label_error for r in got) == sorted(total[rows[i][2]] for i in want)


def test_codes_of_no_rows_and_of_odd_widths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)]):
        assert vector_codes.vector_codes(spark.createDataFrame(rows, kind)).count() == 0
    assert {(r.code, r.error) for r in vector_codes.vector_codes(spark.createDataFrame([(1, [], 1), (2, [], 2)], kind)).collect()} == {("00" * 4, 0)}
    for rows in ([(1, [1.0] * 5, 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.vector_codes(spark.createDataFrame(rows, kind))
    with pytest.raises(Exception, match="too large"):
        vector_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 4, 1), (2, [0.0] * 4, 1)], kind)).count()


def test_bounds_leave_few_entries(monkeypatch):
    """Nearest entries are exact and most distances are never worked out."""
    rng = np.random.default_rng(3)
    book = rng.normal(0, 300, (256, 16)).astype(np.int64)
    book[200:210] = book[7]  # equal entries: the first counts
    parts = book[rng.integers(0, 256, 3000)] + rng.normal(0, 60, (3000, 16)).astype(np.int64)
    entry, distance, measured = vector_codes.VAFile(book).nearest(parts)
    every = ((parts[:, None, :] - book[None]) ** 2).sum(2)
    assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 0.2 * every.size


# ---- 13

def matches(text, rules):
    out = []
    for n, r in enumerate(rules):
        out += [(m.start(), n, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.part)) >= r.least]
    return sorted(out)


def secret_texts(seed, n=150):
    rng = random.Random(seed)
    bits = [
        "password: hunter22", "PassWd='abcdef'", "secret=token : abcdefgh", "api_key = \"A.b/c+d=-_9\"", "APIKEY:short", "apikey==xyz12", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIA123", "AKIAAKIA" + "Z" * 20, "deadbeef" * 3, "deadbeef" * 2, "0123456789abcdef" * 9,
        "日本 naïve 𝔘nicode", "\n", "\t", " ", "=", "'", "ghp_" + "a1B2" * 9, "gho_short", "xoxb-123456789012-abcdefghijkl", "AIza" + "Sy_-0" * 7, "eyJhbGciOi.eyJzdWIiOiIx.sIg-na_tureabcdefghij", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
        "-----BEGIN PUBLIC KEY-----", "token", ":", "tok", "ken: x", "secreT=\x20\x20\"zzzzzz", "passwordpasswd=qwertz", "\u212aey: api_\u212aey=abcdef",
    ]
    return [(rng.choice([1, 2, None, i]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(n)] + [(7, None), (None, None), (8, ""), (9, "token=abcdef " * 3000), (9, "a" * 100_000), (9, "plain"), (9, "plain")]


def test_spans_by_brute_force(spark):
    rules = BASE + ADDED
    rows = secret_texts(1)
    docs = spark.createDataFrame([(i, t, "c", [1]) for i, t in rows], "doc_id long, text string, key string, rules array<int>").repartition(4)
    got = sorted((repr(r.doc_id), [tuple(s) for s in r.found]) for r in secret_scan.find_secrets(docs, rules).collect())
    assert got == sorted((repr(i), matches(t, rules)) for i, t in rows)
    assert {s[1] for _, f in got for s in f} == set(range(len(rules)))
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


def test_rules_without_trigrams_are_tried_on_all(spark):
    """Also rules of one or two letters, and any mixture of both kinds."""
    rules = [SecretRule("two", r"x[0-9]+", 0, 3), SecretRule("word", r"(?:ab|cd){2}z?q", 0, 1)]
    rows = [(1, "x12 x1"), (2, "ababq cdabzq abq"), (3, "none"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chosen in (rules, rules[:1], rules[1:], []):
        if chosen:
            assert {r.doc_id: [tuple(s) for s in r.found] for r in secret_scan.find_secrets(docs, chosen).collect()} == {i: matches(t, chosen) for i, t in rows}
    assert secret_scan.trigram_query(rules[0].pattern) is None and secret_scan.trigram_query(rules[1].pattern)


@pytest.mark.parametrize("pattern", [r"abc", r"ab?c*def", r"(foo|bar)[xy]z", r"(?:one|two)+three", r"a.c.e", r"[a-z]{3}", r"(ab|)cde", r"x(?:yz){2,3}w", r"(?:abc|d)", r"\d+-key", r"(?i:Mixed)Case", r"pre(?:fix|[0-9]+)post"])
def test_queries_hold_in_every_match(pattern):
    """No match of a regex lacks its trigrams: over random texts from its letters."""
    rng = random.Random(pattern)
    query = secret_scan.trigram_query(pattern)
    letters = sorted(set(re.sub(r"\\d|[\[\](){}|?*+.\\:]", "", pattern)) | set("019"))
    hits = 0
    for _ in range(20000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 16)))
        for m in re.finditer(pattern, text):
            hits += 1
            have = secret_scan.trigrams(m.group().lower())
            assert query is None or any(c <= have for c in query), (m.group(), query)
    assert hits or query


def test_postings_are_boolean(spark):
    docs = spark.createDataFrame([(1, "a TOKEN here"), (2, "tok oke but no end"), (3, "ken"), (4, "AKIA"), (5, None)], "doc_id long, text string")
    assert {(r.id, tuple(sorted(r.rules))) for r in secret_scan.candidates(docs, BASE).collect()} == {(1, (0,)), (4, (1,))}


def test_driver_tables_hold_secrets(spark):
    """The base kinds of the smallest table by plain regexes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((r.doc_id, [tuple(s) for s in r.found]) for r in secret_scan.find_secrets(docs).collect())
    assert got == sorted((r.doc_id, matches(r.text, BASE + ADDED)) for r in docs.collect())
