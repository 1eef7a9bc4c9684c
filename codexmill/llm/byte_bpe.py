"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

A piece (one match of the split pattern) is merged as follows: the leaves of a
segment tree stand for byte positions, a leaf holds the rank of the pair that
starts there (infinite if there is none), and an inner node the least rank of
its leaves with the leftmost position. The root names the next merge; a merge
retires one leaf and updates the pairs of the two live neighbours, each in
logarithmic time, so a piece of n bytes takes O(n log n), however long.

Documents are encoded inside Arrow batches of whatever partitions Spark deals.
Pieces and space-delimited chunks seen before come from a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_worker

NONE = 1 << 62
#: Chunks, and pieces, that a worker remembers at most when a group of texts begins; beyond, it starts anew.
MEMO_ENTRIES = 500_000
#: Only chunks and pieces up to this many characters are remembered.
MEMO_CHARS = 64
#: Pieces of more bytes have a tree of their own.
LONG_PIECE = 64
#: Characters of the texts that are encoded together, if there are several.
GROUP_CHARS = 2_000_000


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece, always merging the leftmost pair of the least rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    size = 1 << max(0, (n - 1).bit_length())
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # of the part that starts here
    left = list(range(-1, n - 1))  # start of the live part before
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(at: int, value: int) -> None:
        at += size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    def pair(at: int) -> int:
        middle = end[at]
        if middle >= n:
            return NONE
        rank = ranks.get(piece[at : end[middle]])
        return NONE if rank is None else rank << 32 | at

    while tree[1] < NONE:
        i = tree[1] & 0xFFFFFFFF
        j = end[i]
        end[i] = end[j]
        if end[i] < n:
            left[end[i]] = i
        put(j, NONE)
        put(i, pair(i))
        if left[i] >= 0:
            put(left[i], pair(left[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PairTable:
    """Id of the token that two tokens make, for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids, NONE where a pair makes no token."""
        if not len(self.keys):
            return np.full(len(a), NONE, np.int64)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NONE)


def merge_pieces(pieces: list[bytes], size: int, byte_ids: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Id bytes of many pieces of at most ``size`` (a power of two) bytes: one segment tree a row, all merged in step.

    The same tree and updates as in ``merge_piece``, over tokens' ids in place of
    their bytes; a round does the next merge of every piece that has one.
    """
    count = len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, count)
    spot = np.arange(size)
    alive = spot < length[:, None]
    ids = np.full((count, size + 1), -1, np.int64)
    ids[:, :size][alive] = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    follow = np.tile(np.arange(1, size + 2), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))
    tree = np.full((count, 2 * size), NONE, np.int64)

    def ranked(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        found = pairs.merged(a, b)
        return np.where((a < 0) | (b < 0) | (found == NONE), NONE, found << 16 | at)

    tree[:, size : 2 * size - 1] = ranked(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel(), np.tile(spot[: size - 1], count)).reshape(count, -1)
    for level in range(size.bit_length() - 2, -1, -1):
        w = 1 << level
        tree[:, w : 2 * w] = np.minimum(tree[:, 2 * w : 4 * w : 2], tree[:, 2 * w + 1 : 4 * w : 2])

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        i, new = top & 0xFFFF, top >> 16
        j = follow[rows, i]
        k = follow[rows, j]
        ids[rows, i], ids[rows, j] = new, -1
        alive[rows, j] = False
        follow[rows, i] = k
        before[rows, np.minimum(k, size)] = i
        p = before[rows, i]
        own = ranked(new, ids[rows, np.minimum(k, size)], i)
        # Where no part stands before, the leaf of the merged part is put once more.
        first = p < 0
        p = np.where(first, i, p)
        prior = np.where(first, own, ranked(ids[rows, p], new, p))
        for leaf, value in ((j, NONE), (i, own), (p, prior)):
            at = leaf + size
            tree[rows, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        rows = rows[tree[rows, 1] < NONE]

    flat = ids[:, :size][alive].astype("<u4").tobytes()
    ends = (np.cumsum(alive.sum(1)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Codec:
    """Encoder and decoder for one vocabulary of byte sequences and ranks."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(self.ranks)
        self.pattern = regex.compile(pattern)
        # Two white-space characters in a row, the second a space: there a chunk may not begin.
        self.run = regex.compile(r"\s ")
        self.pieces: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _learn_pieces(self, new: list[str]) -> None:
        """Puts the ids of pieces into the memo."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.pieces[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.pieces[piece] = np.array(merge_piece(raw, self.ranks), "<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, some in by_size.items():
            for at in range(0, len(some), 4096):
                part = some[at : at + 4096]
                self.pieces.update(zip([p for p, _ in part], merge_pieces([r for _, r in part], size, self.byte_ids, self.pairs), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A match of the pattern holds a space only as its first character or in a
        run of white space. So where every space follows a character that isn't
        white space, the text falls into chunks that begin with a space and can be
        split by the pattern one by one. Other texts are split whole.
        """
        at = 0
        while at < len(texts):
            some, n = [], 0
            while at < len(texts) and n < GROUP_CHARS:
                some.append(texts[at])
                n += len(texts[at])
                at += 1
            yield from self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split, chunks = [], set()
        for text in texts:
            if self.run.search(text):
                split.append((self.pattern.findall(text), []))
            else:
                first, *rest = text.split(" ")
                split.append((self.pattern.findall(first), rest))
                chunks.update(rest)
        for memo in (self.pieces, self.spaced):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        spaced = self.spaced
        new = {c: self.pattern.findall(" " + c) for c in chunks if c not in spaced}
        wanted = {p for found in new.values() for p in found}
        wanted.update(p for found, _ in split for p in found)
        pieces = self.pieces
        self._learn_pieces([p for p in wanted if p not in pieces])
        for c, found in new.items():
            spaced[c] = b"".join([pieces[p] for p in found])
        out = [b"".join([pieces[p] for p in found]) + b"".join(map(spaced.__getitem__, rest)) for found, rest in split]
        for memo, names in ((pieces, wanted), (spaced, new)):
            for name in [x for x in names if len(x) > MEMO_CHARS]:
                memo.pop(name, None)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(ranks_path: str, pattern: str) -> Codec:
    """One a worker process."""
    return in_worker(("byte BPE", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def _mapped(docs: DataFrame, source: str, added: str, rows) -> DataFrame:
    """``docs`` with the columns ``added``; ``rows`` makes their values of a batch's values of ``source``."""
    extra = T._parse_datatype_string(added).fields
    names = [f.name for f in extra]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + extra)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(rows(batch.column(source).to_pylist()))
            cols = [batch.column(f.name) for f in schema.fields if f.name not in names]
            cols += [pa.array([v[i] for v in values], kinds[f.dataType.simpleString()]) for i, f in enumerate(extra)]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    A null text is empty: no ids. Columns named like the added ones are replaced;
    an empty table gives no rows.
    """

    def rows(texts):
        return ((len(ids) // 4, ids) for ids in codec(ranks_path, pattern).encode([t or "" for t in texts]))

    return _mapped(docs, text, "n_tokens long, ids binary", rows)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids (null ids: none)."""
    return _mapped(encoded, ids, "decoded binary", lambda values: ((codec(ranks_path, pattern).decode(bytes(v or b"")),) for v in values))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the digests of the ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so that neither ids nor bytes leave the task.
    """

    def rows(texts):
        own = codec(ranks_path, pattern)
        for ids in own.encode([t or "" for t in texts]):
            yield len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _mapped(docs, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
