"""Short codes of vectors, with the nearest codebook entries found by a VA-file.

A vector of integers is cut into equal parts; each part position has a codebook.
Entries are kept as a VA-file: along every dimension their coordinates fall into
cells with the cells' least and greatest coordinate. For a part that asks for its nearest entry, a table
gives the least and greatest squared distance to each cell; sums of these over the
dimensions bound the distance to every entry, and only entries whose lower bound is
not above the smallest upper bound are measured, in integers. So codes are exact.

Rounds alternate with the means of the entries' parts: a task adds up what it
assigned, entry by entry, and Spark sums these rows. Codebooks (at most 256 entries a
part, whatever the table's size) are all that reaches the driver.

Rows whose vector is null or holds a null or non-finite component are left out. Rows
are numbered for the first codebook by id, then vector (null ids last); repeated rows
count each time; fewer rows than entries make smaller codebooks, and an empty table
gives no rows. All vectors must have one width, a multiple of the number of parts, and
components whose squares fit 64 bits; others raise ``ValueError``. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import removed, written

#: Cells along a dimension, and parts that are looked up at once. Both change only the cost.
CELLS, BLOCK = 16, 512


class VAFile:
    """Codebook entries by cells."""

    def __init__(self, entries: np.ndarray):
        """``entries``: integers, a row an entry."""
        self.entries = entries
        n, self.width = entries.shape
        cells = min(CELLS, n)
        # Cells of about equal numbers of entries; equal coordinates share a cell.
        order = np.sort(entries, axis=0)
        marks = order[(np.arange(1, cells) * n) // cells]
        self.cell = np.stack([np.searchsorted(marks[:, d], entries[:, d], side="right") for d in range(self.width)])
        self.low = np.full((self.width, cells), np.iinfo(np.int64).max)
        self.high = np.full((self.width, cells), np.iinfo(np.int64).min)
        for d in range(self.width):
            np.minimum.at(self.low[d], self.cell[d], entries[:, d])
            np.maximum.at(self.high[d], self.cell[d], entries[:, d])
        empty = self.low > self.high
        self.low[empty] = self.high[empty] = 0

    def bounds(self, parts: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each entry (row) to each part (column)."""
        lower = np.zeros((len(self.entries), len(parts)), kind)
        upper = np.zeros_like(lower)
        for d in range(self.width):
            x = parts[:, d]
            under, over = self.low[d][:, None] - x, x - self.high[d][:, None]  # a cell a row
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            lower += (near * near).astype(kind)[self.cell[d]]
            upper += (far * far).astype(kind)[self.cell[d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """``(entry, squared distance, measured)`` of each part, of equal distances the first entry; ``measured`` is the number of distances that were worked out."""
        most = int(max(np.abs(c.astype(np.float64)).max(initial=0) for c in (self.entries, parts)))
        if self.width * 4 * most * most * len(self.entries) >= 1 << 63:
            raise ValueError("vector components are too large: their squared distances pass 64 bits")
        kind = np.int32 if self.width * 4 * most * most < 1 << 31 else np.int64
        entry, distance, measured = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64), 0
        for at in range(0, len(parts), BLOCK):
            x = parts[at : at + BLOCK]
            lower, upper = self.bounds(x, kind)
            who, which = np.nonzero((lower <= upper.min(axis=0)).T)
            measured += len(who)
            away = self.entries[which] - x[who]
            both = np.einsum("ij,ij->i", away, away) * len(self.entries) + which
            first = np.minimum.reduceat(both, np.searchsorted(who, np.arange(len(x))))
            distance[at : at + BLOCK], entry[at : at + BLOCK] = np.divmod(first, len(self.entries))
        return entry, distance, measured


def vectors_of(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """The integer vectors of a batch, a row each."""
    lists = batch.column(name)
    if len(lists) and set(np.unique(lists.value_lengths())) != {width}:
        raise ValueError(f"vectors of other widths than {width}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def assigned(x: np.ndarray, books: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(parts, entries, distances)`` of each part position."""
    step = x.shape[1] // len(books)
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * step : (p + 1) * step])
        entry, distance, _ = VAFile(book).nearest(part)
        yield part, entry, distance


def means(vectors: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The next codebooks: floors of the means of each entry's parts; an unused entry stays."""
    step = width // len(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for p, (part, entry, _) in enumerate(assigned(vectors_of(batch, "x", width), books)):
                n[p] += np.bincount(entry, minlength=len(books[p]))
                order = np.argsort(entry, kind="stable")
                used, start = np.unique(entry[order], return_index=True)
                total[p][used] += np.add.reduceat(part[order], start, axis=0)
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            sums = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype=np.int32) * step, pa.array(total[p][used].ravel()))
            yield pa.record_batch([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), sums], ["part", "entry", "n", "sums"])

    rows = vectors.select("x").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    found = rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(step)]).alias("sums"))
    out = [b.copy() for b in books]
    for r in found.collect():  # a row an entry
        out[r["part"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    huge = F.lit(float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == huge)), F.lit(False))


def vector_codes(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(id, code, error, label_error, codebooks_sha256)`` of each vector that is kept.

    ``code``: two hex digits for each part's entry; ``error``: the squared distances of
    the parts, summed; ``label_error``: the errors of all rows of the same label, null
    being one label; ``codebooks_sha256``: digest of all components, comma-joined.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = rows.sparkSession
    whole = F.transform(F.col(f"`{vector}`"), lambda v: F.floor(v.cast("double") * scale).cast("long"))
    kept = rows.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), whole.alias("x"))
    kept = written(kept, "vectors")
    first = [r["x"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]  # at most `entries` rows
    width = len(first[0]) if first else 0
    if width % parts or any(len(x) != width for x in first):
        raise ValueError(f"vectors of one width, a multiple of {parts}, are needed")
    step = width // parts
    books = [np.array([x[p * step : (p + 1) * step] for x in first], np.int64) for p in range(parts)]
    for _ in range(rounds if width else 0):
        books = means(kept, books, width)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    label_type = kept.schema["label"].dataType.simpleString()
    id_type = kept.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            codes, error = np.full(n, b"00" * (0 if width else parts), dtype=f"S{2 * parts}"), np.zeros(n, np.int64)
            for _, entry, distance in assigned(vectors_of(batch, "x", width), books) if width and n else ():
                codes = np.char.add(codes, np.char.mod(b"%02x", entry))
                error += distance
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(np.char.decode(codes)), pa.array(error)], ["id", "label", "code", "error"])

    coded = written(kept.mapInArrow(encode, f"id {id_type}, label {label_type}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    removed(kept)
    return out
