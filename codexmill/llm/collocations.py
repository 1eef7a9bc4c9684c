"""Phrases whose words keep together, of each language.

All 1- to ``max_words``-grams become rows of ``(lang, phrase, number)`` and are hash
aggregated, length by length. A gram can only be frequent if its parts are: one of more than
``COUNTED`` words is made only where the two grams one word shorter in it are frequent, by a bitmap of
fixed size that may pass a gram too many but never one too few, and its counts
decide. Everything else reads only grams that are frequent enough: a candidate's cuts
join the counts of their first part and rest, scores are integer quotients of decimals, an anti
join drops what is part of an equally frequent phrase one word longer (counts fall
with every word, so no longer phrase need be asked), and a window ranks the rest.

A null or empty text has no words, a null language is ``und``; repeated rows count each time, an
empty table gives no rows, and other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written

#: Bytes of text of which a task combines equal grams before they become rows. It only bounds memory.
BUFFER = 3 << 20
#: Words of a gram up to which all are counted. How many grams a map of shorter ones leaves out depends on how
#: many are frequent, so three words, which a map of pairs would prune only in small corpora, cost the same at all sizes.
COUNTED = 3
#: Bits of the map of frequent grams: 8 MB at any size of the corpus.
MAP_BITS = 1 << 26
#: Tasks that the phrases of one language are dealt to, at least.
SALTS = 64
#: Characters that end a piece, and those between words.
ENDS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in GAPS]] = 1
_KIND[[ord(c) for c in ENDS]] = 2
ROWS = "lang string, phrase string, f long"


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
    """``(lang, text, seen)``: lower-cased texts of one language, joined by ends of pieces; ``seen`` is how many words at its start were in the last buffer.

    A text longer than a buffer is cut between words, and the words before the cut
    that a gram may begin with come again.
    """
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).fill_null(""), strict=True):
            text = text.as_buffer().to_pybytes().lower()  # of bytes: A-Z only
            if len(text) > BUFFER:
                yield from ((lang, part, seen) for part, seen in slices(text))
                continue
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] > BUFFER or sum(size.values()) > 2 * BUFFER:
                full = max(size, key=size.get)
                del size[full]
                yield full, b"\n".join(held.pop(full)), 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts), 0


def slices(text: bytes, carried: int = 16) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``BUFFER`` bytes, cut in a gap; each begins with up to ``carried`` words of the part before."""
    gap, at, tail, seen = _KIND[np.frombuffer(text, np.uint8)] > 0, 0, b"", 0
    while at < len(text):
        later = np.flatnonzero(gap[at + BUFFER :])
        end = at + BUFFER + int(later[0]) if len(later) else len(text)
        part = tail + text[at:end]
        yield part, seen
        _, _, _, starts, stops = words(part)
        first = max(len(starts) - carried, 0)
        seen = len(starts) - first
        tail = part[starts[first] :] if seen else b""
        at = end


def words(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct words, number of each word's entry, piece of each word, starts, stops)``."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate(([False], kind == 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    piece = np.cumsum(kind == 2)[starts] if len(starts) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(stops - starts))).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw[kind == 0].tobytes()))
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, starts, stops


def rows(lang: str, phrases: pa.Array, n: np.ndarray, at_once: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    whole = pa.record_batch([pa.repeat(pa.scalar(lang), len(n)), phrases.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])
    return (whole.slice(at, at_once) for at in range(0, len(n), at_once))


def counted(lang: str, entries: pa.Array, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Equal grams once: a column of entry numbers for each word of the grams."""
    key, parts = columns[0], [columns[0]]
    for column in columns[1:]:
        # Number the grams so far, so that the next word still fits beside the number.
        if len(parts) > 1:
            _, key = np.unique(key, return_inverse=True)
        key = (key << 32) | column
        parts.append(column)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    taken = [entries.take(pa.array(p[first])) for p in parts]
    return rows(lang, pc.binary_join_element_wise(*taken, pa.scalar(" ", pa.large_string())) if len(taken) > 1 else taken[0], n)


def short_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs; the empty phrase stands for all words of the language."""
    for lang, text, seen in buffers(batches):
        entries, ids, piece, _, _ = words(text)
        if len(ids) > seen:
            yield from rows(lang, pa.array([""]), np.array([len(ids) - seen]))
            yield from counted(lang, entries, [ids[seen:]])
        first = np.flatnonzero(piece[:-1] == piece[1:]) if len(ids) > 1 else np.zeros(0, np.int64)
        first = first[first + 1 >= seen]
        if len(first):
            yield from counted(lang, entries, [ids[first], ids[first + 1]])


def hashes(entries: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.array(entries.to_pylist(), dtype=object))


def joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a gram with one more word."""
    with np.errstate(over="ignore"):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ word
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def bits_of(lang: str, h: np.ndarray) -> list[np.ndarray]:
    """Two places in the map for each gram's hash."""
    h = joined(h, pd.util.hash_array(np.array([lang], dtype=object)))
    h = h ^ (h >> np.uint64(32))
    with np.errstate(over="ignore"):
        return [h % np.uint64(MAP_BITS), (h >> np.uint64(32)) * np.uint64(2654435761) % np.uint64(MAP_BITS)]


def gram_bits(size: int) -> Callable:
    """``(at, bits)``: parts of the map that frequent grams of ``size`` words set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for lang in pc.unique(batch.column(0)).to_pylist():
                grams = pc.split_pattern(batch.column(1).filter(pc.equal(batch.column(0), lang)), " ").flatten()
                coded = grams.dictionary_encode()
                word = hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1, size)
                h = word[:, 0]
                for k in range(1, size):
                    h = joined(h, word[:, k])
                found += bits_of(lang, h)
            bit = np.unique(np.concatenate(found))
            at, start = np.unique(bit >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), start) if len(at) else at
            yield pa.record_batch([pa.array(at.astype(np.int64)), pa.array(value.view(np.int64))], ["at", "bits"])

    return run


def frequent(grams: DataFrame, size: int) -> np.ndarray:
    """The map of all frequent grams of ``size`` words, of ``MAP_BITS`` bits however many they are."""
    mine = grams.where(F.size(F.split("phrase", " ")) == size).where("phrase <> ''")
    parts = mine.select("lang", "phrase").mapInArrow(gram_bits(size), "at long, bits long")
    found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MAP_BITS / 64 rows
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def long_grams(size: int, shorter: Broadcast | None) -> Callable:
    """Grams of ``size`` words, with a map only those whose first and last ``size - 1`` words are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shorter.value if shorter else None
        has = lambda bit: (known[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
        for lang, text, seen in buffers(batches):
            entries, ids, piece, _, _ = words(text)
            n = len(ids) - size + 1
            if n < 1:
                continue
            whole = piece[:n] == piece[size - 1 :]
            if shorter:
                word = hashes(entries)[ids]
                h = word[: n + 1]
                for k in range(1, size - 1):
                    h = joined(h, word[k : k + n + 1])
                one, two = bits_of(lang, h)
                ok = has(one) & has(two)
                whole &= ok[:-1] & ok[1:]
            at = np.flatnonzero(whole)
            at = at[at + size > seen]
            if len(at):
                yield from counted(lang, entries, [ids[at + i] for i in range(size)])

    return run


def grams(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = 5, min_count: int = 100) -> list[DataFrame]:
    """``(lang, phrase, f)``: all grams found ``min_count`` times, and with the empty phrase the number of all words; a table of words and pairs and one for each greater length."""
    chosen = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    total = lambda found: found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("phrase") == ""))
    tables = [written(total(chosen.mapInArrow(short_grams, ROWS)), "words-and-pairs")]
    for size in range(3, max_words + 1):
        shorter = None
        if size > COUNTED:
            shorter = frequent(tables[-1], size - 1)
            if not shorter.any():
                break
            shorter = docs.sparkSession.sparkContext.broadcast(shorter)
        tables.append(written(total(chosen.mapInArrow(long_grams(size, shorter), ROWS)).where("phrase <> ''"), "phrases"))
        if shorter:
            shorter.unpersist()
    return tables


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", max_words: int = 5, min_count: int = 100, covered_percent: int = 100, top: int = 2000) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    A phrase of 2 to ``max_words`` words found ``a >= min_count`` times scores
    ``floor(1000 * a * n / (l * r))`` at its lowest-scoring cut (of equal ones the
    first); one that lies in a longer candidate found at least ``covered_percent`` of
    its times is dropped. Order: score and ``a`` descending, then the phrase's bytes.
    """
    if not 2 <= max_words <= 16:
        raise ValueError("phrases have 2 to 16 words")
    tables = grams(docs, lang, text, max_words, min_count)
    every = reduce(DataFrame.unionByName, tables)
    known = every.where("phrase <> ''").select("lang", "phrase", F.col("f").cast("decimal(19,0)").alias("f"))
    total = every.where("phrase = ''").select("lang", F.col("f").cast("decimal(16,0)").alias("n"))
    listed = known.where("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = listed.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    part = lambda name, value: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    # A language may hold most rows, so its total is there once for each of a few salts.
    total = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    scored = salted.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(total, ["lang", "salt"])
    scored = scored.withColumn("score", F.expr("(1000 * (a * n)) div (l * r)"))
    best = scored.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    inner = listed.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(F.expr("array_join(slice(w, 2, size(w)), ' ')"), F.expr("array_join(slice(w, 1, size(w) - 1), ' ')"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = written(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]), "collocations")
    removed(*tables)
    return out
