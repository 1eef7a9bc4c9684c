"""Benchmark decontamination with one Aho-Corasick automaton over test items.

Every window of ``window`` consecutive words of an item (the whole item, if it is
shorter) is a pattern over word numbers. Each document is scanned once; an
occurrence marks the words it covers, and runs of marked words map back to
character offsets of the original text.

The automaton is bounded: items are dealt by hash into blocks of about
``BLOCK_CHARS`` characters. The usual benchmark is one block and then nothing is
shuffled. With more blocks a document is scanned only for those that it may hit:
equal windows have equal anchors (the least hash of two adjacent words), so
documents and blocks are joined on the anchors of their windows. The corpus is then
read twice, however many blocks there are, and each block reads its candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_worker, removed, written

#: Words: runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Characters of the items in one automaton, about.
BLOCK_CHARS = 1_000_000

#: Odd numbers that mix two words' hashes.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

ADDED = "n_words long, hits array<struct<first:long,last:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def lowered(text: str) -> str:
    """A-Z lower-cased; the same number of characters."""
    return text.encode().lower().decode()


class Scanner:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.numbers: dict[str, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(lowered(text))]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at : at + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.automaton.add_word(key, (len(key), tuple(names)))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of words covered (first, last) and the items that have windows here."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.any or not words:
            return runs, items
        for last, (length, names) in self.automaton.iter(tuple(map(self.numbers.get, words, repeat(0)))):
            runs.append((last - length + 1, last))
            items.update(names)
        return joined(runs), items


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs in order, those that touch made one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _pass(docs: DataFrame, items: list[tuple[str, str]], text: str, window: int, again: bool) -> DataFrame:
    names = T._parse_datatype_string(ADDED).fieldNames()
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + T._parse_datatype_string(ADDED).fields)
    shared = docs.sparkSession.sparkContext.broadcast(items)
    number = shared._jbroadcast.id()
    kinds = [
        pa.int64(),
        pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])),
        pa.list_(pa.string()),
        pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = in_worker(("automaton", number, window), lambda: Scanner(shared.value, window))
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            prior = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if again else repeat(([], []))
            for value, (hits, known) in zip(batch.column(text).to_pylist(), prior):  # noqa: B905
                low = lowered(value or "")
                words = WORD.findall(low)
                runs, found = scanner.scan(words)
                if hits:
                    runs = joined(runs + [(h["first"], h["last"]) for h in hits])
                spans = []
                if runs:
                    places = [m.span() for m in WORD.finditer(low)]
                    spans = [{"start": places[a][0], "end": places[b][1]} for a, b in runs]
                cols[0].append(len(words))
                cols[1].append([{"first": a, "last": b} for a, b in runs])
                cols[2].append(sorted(found.union(known or ())))
                cols[3].append(spans)
            arrays = [batch.column(f.name) for f in kept] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.mapInArrow(run, schema)


def anchors(words: list[str], lengths: list[int]) -> np.ndarray:
    """Distinct anchors of all windows of these lengths: a window's least hash of adjacent words, or the hash of its only word."""
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    two = (one[:-1] * MIX[0] ^ one[1:]) * MIX[1]
    found = [np.empty(0, np.uint64)]
    for n in lengths:
        if n == 1:
            found.append(one)
        elif n <= len(words):
            least = two[: len(words) - n + 1].copy()
            for k in range(1, n - 1):
                np.minimum(least, two[k : k + len(least)], out=least)
            found.append(least)
    return np.unique(np.concatenate(found))


def _anchored(rows: DataFrame, keys: list[str], text: str, window: int, lengths: list[int] | None) -> DataFrame:
    """``keys`` (longs), ``anchor`` and ``length``: anchors of the windows of ``lengths``, or of a row's own length where none are given (else ``length`` is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(len(keys)).to_pylist()):
                words = WORD.findall(lowered(value or ""))
                if not words:
                    continue
                found = anchors(words, lengths or [min(window, len(words))]).view(np.int64)
                own = [pa.array(np.full(len(found), batch.column(i)[row].as_py(), np.int64)) for i in range(len(keys))]
                length = pa.nulls(len(found), pa.int32()) if lengths else pa.array(np.full(len(found), min(window, len(words)), np.int32))
                yield pa.RecordBatch.from_arrays([*own, pa.array(found), length], names=[*keys, "anchor", "length"])

    return rows.select(*keys, text).mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", anchor long, length int")


def _by_blocks(docs: DataFrame, items: DataFrame, blocks: int, text: str, window: int) -> DataFrame:
    """``docs`` with ``hits`` and ``items`` of all blocks, each block scanning the distinct texts that share an anchor with it."""
    dealt = items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("long"))
    wanted = written(_anchored(dealt, ["block"], "t", window, None).distinct(), "item-anchors")
    lengths = sorted(r["length"] for r in wanted.select("length").distinct().collect())  # at most ``window`` of them
    value = F.col(f"`{text}`")
    keys = [F.xxhash64(value).alias("_k1"), F.xxhash64(F.lit(1), value).alias("_k2")]
    texts = docs.select(*keys, value.alias("_text"))
    own = ["_k1", "_k2"]
    pairs = _anchored(texts, own, "_text", window, lengths or [window]).join(wanted.select("block", "anchor").distinct(), "anchor").select(*own, "block").distinct()
    # Copies of a text are one candidate.
    asked = written(texts.join(pairs, own).groupBy(*own, "block").agg(F.first("_text").alias("_text")), "candidates", partition_by="block")
    parts = []
    for b in range(blocks):
        some = dealt.where(F.col("block") == b).select("i", "t")
        scanned = _pass(asked.where(F.col("block") == b).select(*own, "_text"), [tuple(r) for r in some.collect()], "_text", window, False)
        parts.append(written(scanned.where(F.size("hits") > 0).select(*own, "hits", "items"), "block-hits"))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    found = written(found.groupBy(*own).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "all-hits")
    removed(wanted, asked, *parts)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys)
    return whole.join(found, own, "left").select("_row.*", "hits", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with what it shares with the benchmark.

    Added: ``n_words``; ``hits``, runs of words (first, last) inside any window that
    occurs; ``n_hit``, their number of words; ``items``, the ids (as strings, sorted)
    whose windows occur, and ``n_items``; ``spans``, the runs as character offsets of
    the text; ``contaminated``: ``n_hit > 0 and 20 * n_hit >= n_words``. Columns of
    these names are replaced. A null text has no words; items with a null id or text
    or without words match nothing; a repeated item id counts once; an empty
    benchmark leaves every document clean.
    """
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    out = docs.drop("n_words", "hits", "items", "spans", "n_hit", "n_items", "contaminated")
    if blocks == 1:
        out = _pass(out, [tuple(r) for r in items.collect()], text, window, False)
    else:
        # No item is left to scan for; hits of the blocks are joined and mapped to the text.
        out = _pass(_by_blocks(out, items, blocks, text, window), [], text, window, True)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
