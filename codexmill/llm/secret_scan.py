"""Secrets in texts: a trigram index picks the texts that a rule's regex is tried on.

From each rule's regex the Boolean query of trigrams is derived that every match
obeys: a disjunction of conjunctions, in lower case. The trigrams of the
texts that occur in some query are the postings ``(trigram, text)``; a text is a candidate of
a rule if it is in the postings of all trigrams of one conjunction. Rules whose regex
has no trigram that every match must hold are tried on all texts. Candidates are then
verified by the regex itself, so spans do not depend on the index.

Everything is DataFrame functions. Postings are keyed by id and hash of the text, so
null and repeated ids share candidates, which only means that a text is verified in vain.
A null or empty text has no spans; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` is a regex without look-around whose matches are never empty; a match counts if its group ``part`` has at least ``least`` characters."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


#: Rules of the base; letters of the words that assign are taken in either case.
BASE = [
    SecretRule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Rules that the method adds: forms of keys and tokens of well-known services.
ADDED = [
    SecretRule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    SecretRule("hub", r"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    SecretRule("maps", r"AIza[A-Za-z0-9_-]+", 0, 39),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
]

#: Most strings an exact part of a regex may stand for before it is taken as anything.
MOST_STRINGS = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Conjunctions of lower-case trigrams one of which holds in every match of ``pattern``; None if there is none.

    A sequence of items is walked with the set of strings that it can have ended with
    since the last item that may be anything: sets of trigrams are taken when such a run
    ends, and joined by ``and``; alternatives are joined by ``or``.
    """
    found = _query(regex_parser.parse(pattern))
    least = [c for c in found if not any(other < c for other in found)]
    return None if frozenset() in least else sorted(least, key=sorted)


def _strings(op, value) -> list[str] | None:
    """All strings, lower-cased, that an item can be; None if they are too many."""
    name = str(op)
    if name == "LITERAL":
        return [chr(value).lower()] if chr(value).isascii() else None
    if name == "IN":
        out: set[str] = set()
        for kind, v in value:
            if str(kind) == "LITERAL":
                out.add(chr(v))
            elif str(kind) == "RANGE":
                out.update(map(chr, range(v[0], min(v[1], v[0] + MOST_STRINGS) + 1)))
            else:
                return None
        low = sorted({c.lower() for c in out})
        return low if len(low) <= 8 and all(c.isascii() for c in low) else None
    if name == "SUBPATTERN":
        return _run(value[-1])
    if name == "BRANCH":
        runs = [_run(b) for b in value[1]]
        return None if any(r is None for r in runs) else sorted({s for r in runs for s in r})
    if name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] <= 3 and (inner := _run(value[2])) is not None:
        return _limited({"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)})
    return None


def _limited(strings) -> list[str] | None:
    return sorted(strings) if len(strings) <= MOST_STRINGS else None


def _run(items) -> list[str] | None:
    out = [""]
    for op, value in items:
        more = _strings(op, value)
        out = None if more is None or len(out) * len(more) > MOST_STRINGS else [a + b for a in out for b in more]
        if out is None:
            return None
    return out


def _both(a: set[frozenset[str]], b: set[frozenset[str]]) -> set[frozenset[str]]:
    """``and`` of two disjunctions; one of them alone, which both imply, if there would be too many conjunctions."""
    if len(a) * len(b) > MOST_STRINGS:
        return b if frozenset() in a else a
    return {x | y for x in a for y in b}


def _query(items) -> set[frozenset[str]]:
    query, run = {frozenset()}, [""]
    for op, value in items:
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = [a + b for a in run for b in more]
            continue
        query, run = _both(query, {trigrams(s) for s in run}), [""]
        name, inner = str(op), None
        if more is not None:
            run = more
        elif name == "SUBPATTERN":
            inner = _query(value[-1])
        elif name == "BRANCH":
            inner = set().union(*(_query(b) for b in value[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            inner = _query(value[2])
        if inner:
            query = _both(query, inner)
    return _both(query, {trigrams(s) for s in run})


def postings(docs: DataFrame, asked: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, key, trigram)``: which of the trigrams asked for each text holds, once."""
    starts = {t[0] for t in asked}
    pattern = f"(?=([{''.join(re.escape(c) for c in sorted(starts))}](?s:..)))"
    whole = F.col(f"`{text}`")
    # A look-ahead finds every place in one pass, where substrings would walk the text anew for each.
    held = F.array_intersect(F.array(*[F.lit(t) for t in asked]), F.regexp_extract_all(F.lower(whole), F.lit(pattern), F.lit(1)))
    return docs.where(whole != "").select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole).alias("key"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: list[SecretRule], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, key, rules)``: numbers of the rules whose trigram query a text fulfils; rules without a query are not among them."""
    asked = [(n, m, t, len(clause)) for n, r in enumerate(rules) for m, clause in enumerate(trigram_query(r.pattern) or []) for t in sorted(clause)]
    if not asked:
        return docs.limit(0).select(F.col(f"`{id_col}`").alias("id"), F.lit(0).cast("long").alias("key"), F.array(F.lit(0)).alias("rules"))
    item = lambda rule, clause, trigram, size: F.struct(F.lit(rule).alias("rule"), F.lit(clause).alias("clause"), F.lit(trigram).alias("trigram"), F.lit(size).alias("size"))
    terms = docs.sparkSession.range(1).select(F.inline(F.array(*[item(*a) for a in asked])))  # grows with the rules only
    found = postings(docs, sorted({t for _, _, t, _ in asked}), id_col, text)
    met = found.join(F.broadcast(terms), "trigram").groupBy("id", "key", "rule", "clause", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    return met.groupBy("id", "key").agg(F.collect_set("rule").alias("rules"))  # at most a number for each rule


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of all earlier items, for each item of an array of longs; in blocks, so that a long array is not copied at each step."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<long>")
    summed = lambda c: F.aggregate(c, zero, lambda s, v: s + v)
    sums = lambda c: F.aggregate(c, F.struct(zero.alias("s"), empty.alias("a")), lambda st, v: F.struct((st["s"] + v).alias("s"), F.array_append(st["a"], st["s"]).alias("a")))["a"]
    n_blocks = F.ceil(F.size(lengths) / block).cast("int")
    blocks = F.transform(F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(lengths, i * block + 1, F.lit(block)))
    before = sums(F.transform(blocks, summed))
    return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(sums(b), lambda v: v + s)))


def spans(text: Column, rule: SecretRule, number: int) -> Column:
    """Array of ``(start, number, stop)`` of a rule's matches, leftmost and not overlapping, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part)) if rule.part else found
    between = F.transform(F.split(text, rule.pattern, -1), lambda s: F.length(s).cast("long"))
    lengths = F.transform(found, lambda s: F.length(s).cast("long"))
    # A match starts after all earlier matches and the text between them.
    start = F.zip_with(running(F.zip_with(between, lengths, lambda a, b: a + F.coalesce(b, F.lit(0)))), between, lambda a, b: a + b)
    rows = F.zip_with(F.arrays_zip(start.alias("start"), lengths.alias("size")), parts, lambda at, part: F.struct(at["start"].alias("start"), F.lit(number).alias("number"), (at["start"] + at["size"]).alias("stop"), F.length(part).alias("part")))
    kept = F.filter(rows, lambda r: r["part"] >= rule.least)
    return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["number"].alias("number"), r["stop"].alias("stop")))


def find_secrets(docs: DataFrame, rules: list[SecretRule] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id and ``found``, the spans ``(start, number, stop)`` of all rules by start, then rule number; ``number`` counts the rules from 0."""
    rules = BASE + ADDED if rules is None else rules
    whole = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole.alias("_text"), F.xxhash64(whole).alias("_key"))
    picked = written(candidates(docs, rules, id_col, text), "candidates")  # of known size, so that texts stay in place if it is small
    both = rows.join(picked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")), "left")
    none = F.array().cast("array<struct<start:bigint,number:int,stop:bigint>>")
    every = []
    for n, rule in enumerate(rules):
        tried = F.array_contains("rules", n) if trigram_query(rule.pattern) is not None else F.lit(True)
        every.append(F.when(tried & F.col("_text").rlike(rule.pattern), spans(F.col("_text"), rule, n)).otherwise(none))
    return both.select(F.col("_id").alias(id_col), F.array_sort(reduce(lambda a, b: F.concat(a, b), every)).alias("found"))


def listed(found: Column, rules: list[SecretRule]) -> Column:
    """Spans as ``kind:start:stop``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda r: F.concat_ws(":", F.get(kinds, r["number"]), r["start"].cast("string"), r["stop"].cast("string"))), ",")
