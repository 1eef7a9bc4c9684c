"""Language-model scoring by prediction by partial matching.

The model is a trie of byte contexts of up to ``ORDER`` bytes with the counts of
the training documents, frozen. A byte is coded in the longest context that the
trie knows; a byte that this context has not seen costs an escape (method C) to
the next shorter one, where all bytes that the longer context has seen are
excluded. Below the empty context the bytes not yet excluded are equally likely.

With full counts a context's bytes are a subset of those of its suffix, so what
remains of the suffix after exclusion depends on the longer context alone. It is
stored with that context, and a byte's code length is a chain of look-ups.

A text is the sequence of its words: lower-cased (A-Z), joined by single spaces
and closed by an end byte. So the trie's score and the unigram score below are
log probabilities of the same sequence.

All training documents are counted, on the executors, into tables of grams and of
words. Both grow with the corpus. The trie is scored in blocks of contexts that
share their last two bytes (every longer context of a position is in the same
block), each of bounded size; the documents are scored once for each block. Word
counts are looked up in a bounded broadcast of the most frequent words, and the
rest by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_contexts import Index, counted, grams
from .common import in_worker, written

#: Bytes of context at most.
ORDER = 5
#: Grams of the highest order in one block of the trie, about.
BLOCK_GRAMS = 4_000_000
#: Most frequent words that are broadcast, at most.
HEAD_WORDS = 200_000
#: Bytes counted or scored at once, and partial counts a task holds.
CHUNK_BYTES, HELD = 1 << 20, 400_000

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
END = b"\n"
#: The end token's key among the words (no word holds a line feed).
END_WORD = "\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def sequence(words: list[bytes]) -> bytes:
    """The bytes to code, after a start context of end bytes."""
    return END * ORDER + b" ".join(words) + END


# ---- training counts

def count_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, gram, n)``: counts of words (gram null) and of highest-order grams (word null) of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, numbers = np.empty(0, np.uint64), np.empty(0, np.int64)

        def out(word, gram, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["word", "gram", "n"])

        def flushed(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal keys, numbers
            if len(words) > least:
                for at in range(0, len(names := list(words)), 100_000):
                    some = names[at : at + 100_000]
                    yield out([w.decode() for w in some], [None] * len(some), [words[w] for w in some])
                words.clear()
            if len(keys) > least:
                for at in range(0, len(keys), 500_000):
                    some = keys[at : at + 500_000].astype(np.int64)
                    yield out(pa.nulls(len(some), pa.string()), some, numbers[at : at + 500_000])
                keys, numbers = keys[:0], numbers[:0]

        def add(parts: list[bytes]) -> None:
            nonlocal keys, numbers
            own, n = counted(np.concatenate([grams(np.frombuffer(p, np.uint8), ORDER + 1) for p in parts]))
            keys, numbers = counted(np.concatenate([keys, own]), np.concatenate([numbers, n]))

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            held: list[bytes] = []
            size = 0
            for value in batch.column(0).to_pylist():
                own = words_of(value)
                words.update(own)
                words[END_WORD.encode()] += 1
                whole = sequence(own)
                # A long text in parts that overlap by the context.
                for at in range(0, len(whole) - ORDER, CHUNK_BYTES):
                    held.append(whole[at : at + CHUNK_BYTES + ORDER])
                    size += len(held[-1])
                    if size >= CHUNK_BYTES:
                        add(held)
                        held, size = [], 0
            if held:
                add(held)
            yield from flushed(HELD)
        yield from flushed(0)

    partial = docs.select(F.col(f"`{text}`").alias("_text")).mapInArrow(run, "word string, gram long, n long")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


# ---- the trie

class Trie:
    """Look-up arrays of one block of contexts.

    By order j: ``grams[j]`` indexes the grams of j context bytes; ``first[j]`` is
    their log probability if coding starts there; ``log_n[j]`` the log of their
    count. ``contexts[j]`` indexes contexts; ``escape[j]`` is the log escape
    probability if coding starts there; ``rest[j]`` and ``on[j]`` belong to the next
    shorter context once the bytes seen here are excluded: log of its remaining
    count and symbols, and its log escape probability.
    """

    def __init__(self, top_keys: np.ndarray, top_counts: np.ndarray, low_keys: np.ndarray, low_counts: np.ndarray):
        """``top``: grams of the highest order of the block; ``low``: grams of order 1 of the whole trie."""
        self.grams, self.first, self.log_n, self.contexts, self.escape, self.rest, self.on = ([None] * (ORDER + 1) for _ in range(7))
        below = None
        for order in range(ORDER + 1):
            if order < 2:
                keys, n = counted(low_keys & np.uint64((1 << 8 * (order + 1)) - 1), low_counts)
            else:
                keys, n = counted(top_keys & np.uint64((1 << 8 * (order + 1)) - 1), top_counts)
            n = n.astype(float)
            contexts, context = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, symbols = np.bincount(context, n, len(contexts)), np.bincount(context, minlength=len(contexts)).astype(float)
            self.grams[order], self.contexts[order] = Index(keys), Index(contexts)
            with np.errstate(divide="ignore"):
                self.first[order] = np.log(n / (total + symbols)[context]).astype(np.float32)
                self.log_n[order] = np.log(n).astype(np.float32)
                self.escape[order] = np.log(symbols / (total + symbols)).astype(np.float32)
                if order:
                    low, low_n, low_contexts, low_total, low_symbols = below
                    seen_below = low_n[np.searchsorted(low, keys & np.uint64((1 << 8 * order) - 1))]
                    at = np.searchsorted(low_contexts, contexts & np.uint64((1 << 8 * (order - 1)) - 1))
                    left, kinds = low_total[at] - np.bincount(context, seen_below, len(contexts)), low_symbols[at] - symbols
                    self.rest[order] = np.log(np.maximum(left + kinds, 1)).astype(np.float32)
                    self.on[order] = np.where(kinds > 0, np.log(np.maximum(kinds, 1) / np.maximum(left + kinds, 1)), 0).astype(np.float32)
            below = keys, n, contexts, total, symbols
        self.unseen = -np.log(max(1, 256 - len(self.log_n[0]))) if len(self.log_n[0]) else -np.log(256)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each highest-order gram."""
        at = self.grams[ORDER].find(keys)
        if len(self.first[ORDER]):
            out = self.first[ORDER][np.maximum(at, 0)]
        else:
            out = np.zeros(len(keys), np.float32)
        left = np.flatnonzero(at < 0)
        out[left] = 0
        longer = np.full(len(left), -1)  # the context coded in before, of one order more
        for order in range(ORDER, -1, -1):
            own = keys[left] & np.uint64((1 << 8 * (order + 1)) - 1)
            at, context = self.grams[order].find(own), self.contexts[order].find(own >> np.uint64(8))
            found, starts = at >= 0, longer < 0
            a = found & starts
            out[left[a]] += self.first[order][at[a]]
            a = found & ~starts
            if a.any():
                out[left[a]] += self.log_n[order][at[a]] - self.rest[order + 1][longer[a]]
            a = ~found & starts & (context >= 0)
            out[left[a]] += self.escape[order][context[a]]
            a = ~found & ~starts
            if a.any():
                out[left[a]] += self.on[order + 1][longer[a]]
            left, longer = left[~found], np.where(context >= 0, context, longer)[~found]
        out[left] += np.float32(self.unseen)
        return out


def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    """Block of each gram, by its last two context bytes."""
    return (((keys >> np.uint64(8)) & np.uint64(0xFFFF)) * np.uint64(40503) >> np.uint64(4)) % np.uint64(blocks)


def _block_column(gram, blocks: int):
    return F.shiftright(F.shiftright(gram, 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(40503), 4) % blocks


# ---- scoring

def _score_pass(docs: DataFrame, counts: tuple, block: int, blocks: int, head: dict | None) -> DataFrame:
    """Per row: its key, the log10 probability of its bytes in this block and, with ``head``, its word counts.

    The block's counts are broadcast, and each worker makes its trie of them. The
    result is written, so the broadcasts are freed.
    """
    spark = docs.sparkSession
    shared, shared_head = spark.sparkContext.broadcast(counts), spark.sparkContext.broadcast(head)
    number = shared._jbroadcast.id()
    names = ["_k1", "_k2", "part", "n_tokens", "head_known", "head_log", "tail_words", "tail_counts"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = in_worker(("trie", number), lambda: Trie(*shared.value)), shared_head.value
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            cols: list[list] = [[] for _ in names]
            held: list[bytes] = []
            owner: list[int] = []
            sums = np.zeros(batch.num_rows)

            def add() -> None:
                if not held:
                    return
                lengths = np.fromiter(map(len, held), np.int64, len(held))  # noqa: B023
                ends = np.cumsum(lengths)
                use = np.ones(ends[-1], bool)
                for k in range(ORDER):
                    use[ends - lengths + k] = False
                keys = grams(np.frombuffer(b"".join(held), np.uint8), ORDER + 1)[use[ORDER:]]  # noqa: B023
                if blocks > 1:
                    mine = block_of(keys, blocks) == block
                    values = np.zeros(len(keys), np.float64)
                    values[mine] = own.log_probabilities(keys[mine])
                else:
                    values = own.log_probabilities(keys)
                starts = np.cumsum(lengths - ORDER) - (lengths - ORDER)
                np.add.at(sums, owner, np.add.reduceat(values, starts, dtype=np.float64))  # noqa: B023
                held.clear()  # noqa: B023
                owner.clear()  # noqa: B023

            size = 0
            for row, value in enumerate(batch.column("_text").to_pylist()):
                words = words_of(value)
                whole = sequence(words)
                for at in range(0, len(whole) - ORDER, CHUNK_BYTES):
                    held.append(whole[at : at + CHUNK_BYTES + ORDER])
                    owner.append(row)
                    size += len(held[-1])
                    if size >= CHUNK_BYTES:
                        add()
                        size = 0
                if known is None:
                    continue
                cols[3].append(len(words) + 1)
                logs = list(map(known.get, words))
                tail = Counter(w for w, x in zip(words, logs, strict=True) if x is None)
                cols[4].append(len(words) - tail.total())
                cols[5].append(float(np.sum([x for x in logs if x is not None])))
                cols[6].append([w.decode() for w in tail])
                cols[7].append(list(tail.values()))
            add()
            cols[0], cols[1] = batch.column("_k1"), batch.column("_k2")
            cols[2] = sums / np.log(10)
            upto = 3 if known is None else len(names)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols[:upto], kinds)], names=names[:upto])  # noqa: B905

    schema = "_k1 long, _k2 long, part double"
    if head is not None:
        schema += ", n_tokens long, head_known long, head_log double, tail_words array<string>, tail_counts array<long>"
    out = written(docs.select("_k1", "_k2", "_text").mapInArrow(run, schema), "ppm-scores")
    shared.destroy()
    shared_head.destroy()
    return out


def score(docs: DataFrame, training: DataFrame, text: str = "text", id_col: str = "doc_id", block_grams: int = BLOCK_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score.

    ``training`` holds the documents to learn from. Tokens are words
    (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end. ``base_score`` is the
    log10 probability by add-one unigram counts, ``score`` that by the trie. A null
    text is empty: it has the end token alone. Without training documents each byte
    costs log10(256) and each token log10(1). Equal rows are scored once and each
    keep their row; columns of these names are replaced.
    """
    counts = written(count_corpus(training, text), "ppm-counts")
    trained = counts.where("gram is not null").select("gram", "n")
    words = counts.where("gram is null").select("word", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = facts["total"], facts["distinct"]

    # Words of at least 2^level occurrences, the lowest level at which they fit the bound.
    levels = words.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()
    least, held = None, 0
    for r in levels:
        held += r["k"]
        if held > head_words:
            break
        least = r["level"]
    frequent = words.where(F.col("n") >= (1 << least)) if least is not None else words.limit(0)
    top = frequent.toArrow()
    log = np.log10(top.column("n").to_numpy() + 1.0)
    head = dict(zip([w.encode() for w in top.column("word").to_pylist()], log.tolist(), strict=True))
    end_count = words.where(F.col("word") == END_WORD).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    n_blocks = max(1, -(-trained.count() // block_grams))
    low = trained.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,536 rows
    column = lambda t, c, k: t.column(c).to_numpy().astype(k)

    key = [F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("_k1"), F.xxhash64(F.lit(1), F.col(f"`{text}`"), F.col(f"`{id_col}`")).alias("_k2")]
    keyed = docs.select(*key, F.col(f"`{text}`").alias("_text"))
    parts = []
    for b in range(n_blocks):
        own = (trained if n_blocks == 1 else trained.where(_block_column(F.col("gram"), n_blocks) == b)).toArrow()
        block = (column(own, "gram", np.uint64), column(own, "n", np.int64), column(low, "gram", np.uint64), column(low, "n", np.int64))
        del own
        parts.append(_score_pass(keyed, block, b, n_blocks, head if b == 0 else None))

    # Of equal rows one: their values are the same.
    first = parts[0]
    asked = first.select("_k1", "_k2", F.explode(F.arrays_zip(F.col("tail_words").alias("w"), F.col("tail_counts").alias("c"))).alias("t")).select("_k1", "_k2", F.col("t.w").alias("word"), F.col("t.c").alias("c"))
    rare = words.where(F.col("n") < (1 << least)) if least is not None else words
    tails = asked.join(rare, "word").groupBy("_k1", "_k2", "word").agg(F.first("c").alias("c"), F.first("n").alias("n"))
    tails = tails.groupBy("_k1", "_k2").agg(F.sum("c").alias("tail_known"), F.sum(F.col("c") * F.log10(F.col("n") + 1)).alias("tail_log"))
    one = first.groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in ("part", "n_tokens", "head_known", "head_log")])
    for more in parts[1:]:
        one = one.join(more.groupBy("_k1", "_k2").agg(F.first("part").alias("_more")), ["_k1", "_k2"]).withColumn("part", F.col("part") + F.col("_more")).drop("_more")
    scored = one.join(tails, ["_k1", "_k2"], "left").select(
        "_k1",
        "_k2",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(end_count > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) + F.log10(F.lit(end_count + 1.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"),
        F.col("part").alias("score"),
    )
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key)
    return whole.join(scored, ["_k1", "_k2"]).select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in names], *names)
