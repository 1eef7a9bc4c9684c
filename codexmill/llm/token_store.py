"""Token ids in directly addressable codes.

Encoded documents are stored in segments of about a quarter million tokens. A segment
splits every id into bytes, low byte first, and stores them by level: level 0
has one byte of every id, level l one byte of each id of more than l bytes.
A bitmap for each level says which of its ids continue on the next, and a
directory of the ones before each block of 512 bits turns a position into the
position on the next level. So any token is read with one byte, one bit and one
rank a level, without decoding its neighbours.

The file format is Parquet whose rows are segments: Spark's committer makes the
write atomic, readers prune to the segment and columns they need, and it works
on every store that Spark writes to.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_worker

SEGMENT_TOKENS = 1 << 18
BLOCK_BITS = 512
#: Distinct words a worker remembers at most; then it starts anew.
MEMO_ENTRIES = 800_000
#: Bytes of the texts that are encoded together, about.
GROUP_BYTES = 8_000_000
#: Bytes of text in one part of the store, about.
PART_BYTES = 64 << 20

SEGMENT_SCHEMA = "part int, local_start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, levels array<binary>, continues array<binary>, ranks array<binary>"


# ---- directly addressable codes

def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Bytes, continuation bitmaps and rank directories by level; at least one level."""
    rest = ids.astype("<u4")
    levels, bitmaps, ranks = [], [], []
    while True:
        levels.append((rest & 255).astype(np.uint8).tobytes())
        rest = rest >> 8
        more = rest > 0
        padded = np.zeros(-(-max(len(more), 1) // BLOCK_BITS) * BLOCK_BITS, bool)
        padded[: len(more)] = more
        bitmaps.append(np.packbits(padded, bitorder="little").tobytes())
        ones = padded.reshape(-1, BLOCK_BITS).sum(1)
        ranks.append((np.cumsum(ones) - ones).astype("<u4").tobytes())
        rest = rest[more]
        if not len(rest):
            return levels, bitmaps, ranks


def unpack(levels: list[bytes], bitmaps: list[bytes], first: int = 0, last: int | None = None) -> np.ndarray:
    """All ids of a segment."""
    lows = [np.frombuffer(x, np.uint8).astype("<u4") for x in levels]
    out = lows[-1]
    for level in range(len(levels) - 2, -1, -1):
        bits = np.unpackbits(np.frombuffer(bitmaps[level], np.uint8), bitorder="little")[: len(lows[level])].astype(bool)
        here = lows[level].copy()
        here[bits] |= out << 8
        out = here
    return out[first:last]


def token(levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes], at: int) -> int:
    """The id at one position, by one bit and one rank a level."""
    value = 0
    for level, low in enumerate(levels):
        value |= low[at] << 8 * level
        bits = bitmaps[level]
        if not bits[at >> 3] >> (at & 7) & 1:
            return value
        block = at // BLOCK_BITS
        before = int.from_bytes(ranks[level][4 * block : 4 * block + 4], "little")
        inside = int.from_bytes(bits[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8], "little")
        at = before + (inside & ((1 << at % BLOCK_BITS) - 1)).bit_count()
    raise ValueError("a bitmap continues beyond the last level")


# ---- the tokenizer

# What a tokenizer file must say for its ids to be found word by word.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern on lower-case ASCII.
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
#: ASCII punctuation at the end of a word.
TAIL = re.compile(r"[!-/:-@\[-`{-~]+\Z")
#: Where A-Z may not be lower-cased first: special tokens have a bar and are matched before; some marks compose with small letters only.
CASED = "[|\u0300-\u037f]"


def splits_at_space(spec: dict) -> bool:
    """Whether the ids of a text are those of its words, one after the other, and A-Z may be lower-cased before."""
    normal, before, model = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}], spec["model"]
    steps = normal.get("normalizers") or []
    first = before[0]
    return (
        [n.get("type") for n in steps] == NORMALIZERS
        and (steps[1].get("pattern"), steps[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and (first.get("type"), first.get("behavior"), first.get("invert"), first.get("pattern")) == ("Split", "Removed", True, {"Regex": SPLIT})
        and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in before[1:]] == [("ByteLevel", False, False)]
        and spec.get("post_processor") is None
        and spec.get("truncation") is None
        and spec.get("padding") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all("|" in t["content"] for t in spec.get("added_tokens") or [])
    )


class Words:
    """A tokenizer of the tokenizers library with a memo of words.

    If the tokenizer's file shows that it drops white space and never joins
    characters on both sides of it (``splits_at_space``), the ids of a text are those
    of its words; otherwise whole texts go through the library. Each new word is cut
    into matches of the split pattern, and each new match goes through the library
    once. Matches of letters go many at a time: their ids end at each token that
    closes a word (its string has the word-end suffix); if there are not as many as
    words, they go one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = splits_at_space(spec)
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for s, i in vocab.items() if suffix and s.endswith(suffix)]] = True
        self.memo: dict[str, bytes] = {}

    def _library(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of words that the split pattern matches whole, and of others that can't be cut, one library call for many."""
        letters = [w for w in words if w.isalpha()] if self.closes.any() else []
        groups = [letters[at : at + 1000] for at in range(0, len(letters), 1000)]
        rest = [w for w in words if not w.isalpha()] if letters else words
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                yield from zip(some, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True)
            else:
                rest = rest + some
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            yield w, np.array(e.ids, "<u4").tobytes()

    @staticmethod
    def pieces(word: str) -> list[str]:
        """Parts that the split pattern matches one by one; a word of which that isn't certain is one part."""
        if "|" in word:
            return [word]
        if word.isascii():
            return ASCII_PIECE.findall(word.lower())
        tail = TAIL.search(word)
        if tail and tail.start():
            last = word[tail.start() - 1]
            # Latin letters whose small form is one letter too: they don't join the punctuation.
            if last < "\u0250" and last.isalpha() and last.lower().isalpha():
                return [word[: tail.start()], tail[0]]
        return [word]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and how many each has."""
        if len(self.memo) + len(words) > MEMO_ENTRIES:
            self.memo.clear()
        memo = self.memo
        new = [w for w in words if w not in memo]
        cut = {w: self.pieces(w) for w in new if not w.isalpha()}
        whole = {w for w in new if w not in cut}
        whole.update(p for parts in cut.values() for p in parts if p not in memo)
        memo.update(self._library(list(whole)))
        memo.update((w, b"".join([memo[p] for p in parts])) for w, parts in cut.items() if w not in memo)
        found = [memo[w] for w in words]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of some texts: words are numbered by their first occurrence, and only distinct ones are looked up."""
        low = pc.if_else(pc.match_substring_regex(texts, CASED), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(low)
        numbered = split.flatten().dictionary_encode()
        ids, n = self.ids_of(numbered.dictionary.to_pylist())
        word = numbered.indices.to_numpy()
        long = n[word]
        ends = np.r_[0, np.cumsum(long)]
        first = (np.cumsum(n) - n)[word]
        out = ids[np.repeat(first - ends[:-1], long) + np.arange(ends[-1])]
        at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; a null text has none."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        at = 0
        while at < len(texts):
            to, n = at + 1, sizes[at]
            while to < len(texts) and n + sizes[to] <= GROUP_BYTES:
                n += sizes[to]
                to += 1
            some = pc.fill_null(texts.slice(at, to - at), "")
            at = to
            if not self.by_word:
                for e in self.tokenizer.encode_batch_fast(some.to_pylist(), add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()
            elif n > 2 * GROUP_BYTES:  # one huge text, in parts that end at white space
                raw, got = some[0].as_py().encode(), []
                while raw:
                    end = next((i for i in range(GROUP_BYTES, len(raw)) if raw[i] in b" \t\n\v\f\r"), len(raw))
                    got += self._encode(pa.array([raw[:end].decode()], pa.string()))
                    raw = raw[end:]
                yield np.concatenate(got).tobytes()
            else:
                for ids in self._encode(some):
                    yield ids.tobytes()


def words(path: str) -> Words:
    """One a worker process."""
    return in_worker(("words", path), lambda: Words(path))


# ---- writing and reading

def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text", parts: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encodes all documents, each followed by ``end_id``, into segments under ``path``.

    Documents are in ascending order of id (nulls first; equal ids by a hash of
    the text): partitions are ranges of ids, files and segments follow them; ``parts``
    of them, by default as many as the session's shuffle partitions, and more where a
    part would have over ``PART_BYTES`` of text. A null
    text is empty, so only the end id. Segments hold whole documents; one that is
    longer than a segment has its own. Other columns are not stored. An empty table
    writes no segments.
    """
    spark = docs.sparkSession
    if not parts:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).alias("n")).first()["n"]
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held_ids: list = []
        held: list[bytes] = []
        n = 0

        def segment() -> pa.RecordBatch:
            levels, bitmaps, ranks = pack(np.frombuffer(b"".join(held), "<u4"))
            values = [part, start, n, held_ids, [len(x) // 4 for x in held], levels, bitmaps, ranks]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.binary())] * 3]
            names = ["part", "local_start", "n_tokens", "doc_ids", "doc_tokens", "levels", "continues", "ranks"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            encoded = words(tokenizer_path).encode(batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                if held and n + len(ids) // 4 + 1 > segment_tokens:
                    yield segment()
                    start, n = start + n, 0
                    held_ids, held = [], []
                held_ids.append(doc)
                held.append(ids + tail)
                n += len(ids) // 4 + 1
        if held:
            yield segment()

    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_text"))
    ordered = ordered.repartitionByRange(parts, "_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))
    ordered.mapInArrow(run, SEGMENT_SCHEMA).write.parquet(f"{path}/segments")
    # Where each part begins: one row a part.
    totals = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    totals.select("part", before.alias("part_start")).write.parquet(f"{path}/parts")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments with ``start``, their place among all ids."""
    parts = spark.read.schema("part int, part_start long").parquet(f"{path}/parts")
    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{path}/segments")
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start", "local_start")


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32 and, on request, ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                ids, counts, first = unpack(get("levels"), get("continues")), get("doc_tokens"), get("start")
                ends = np.cumsum(counts).tolist()
                pieces = [ids[e - c : e] for e, c in zip(ends, counts, strict=True)]
                cols = [get("doc_ids"), [first + e - c for e, c in zip(ends, counts, strict=True)], counts, [zlib.crc32(p.tobytes()) for p in pieces]]
                if with_ids:
                    cols.append([p.tolist() for p in pieces])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)  # noqa: B905

    wanted = segments(spark, path).select("start", "doc_ids", "doc_tokens", "levels", "continues")
    return wanted.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


#: Positions of a segment that are looked up in one row.
AT_ONCE = 4096


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """``positions`` with ``token_id``: random access, by one rank a level; null outside of the store.

    A position joins its segment by the segment's number in the sorted list of
    starts, which has one row a segment (about one for a quarter million tokens).
    Distinct positions of a segment go to Python ``AT_ONCE`` at most in a row, so a
    segment that is asked often is dealt to many rows. Other columns are kept as
    they are, whatever their names; one named ``token_id`` is replaced.
    """
    asked = positions.select(F.struct("*").alias("_row"), F.col(f"`{position}`").cast("long").alias("_p"))
    rows = segments(spark, path).withColumn("_end", F.col("start") + F.col("n_tokens"))
    width = SEGMENT_TOKENS
    spans = rows.select("start", "_end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("_end") - 1) / width))).alias("_slot"))
    near = F.broadcast(spans) if rows.count() < 100_000 else spans
    once = asked.select("_p").where("_p is not null").distinct().withColumn("_slot", F.floor(F.col("_p") / width))
    found = once.join(near, "_slot").where("_p >= start and _p < _end")
    lists = found.groupBy("start", F.floor(F.col("_p") / AT_ONCE)).agg(F.collect_list("_p").alias("_at")).select("start", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [token(r["levels"], r["continues"], r["ranks"], p - r["start"]) for p in r["_at"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["_at"], pa.int64()), pa.array(ids, pa.int64())], names=["_p", "token_id"])

    got = lists.join(rows.select("start", "levels", "continues", "ranks"), "start").mapInArrow(run, "_p long, token_id long")
    return asked.join(got, "_p", "left").select(*[F.col("_row")[c].alias(c) for c in positions.columns if c != "token_id"], "token_id")
