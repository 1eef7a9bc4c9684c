"""Which texts hold which patterns, by seeds: an equality join in place of a nested loop.

A pattern is filed under its first bytes in lower case: all of them up to eight, else the first 8 or 16. Tasks
hash the runs of those lengths at every byte of a text and name the runs that may be a seed, by a bit map
of all seeds whose size is bounded. The two meet on the seed, and pairs of longer patterns are checked.
Upper and lower case are the same, as in lower case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import removed, written

#: Longest pattern that its seed holds whole; bytes of texts hashed at once, which bounds memory.
WHOLE, AT_ONCE = 8, 1 << 16
#: Bits of the map for each seed, and of the whole map, as powers of two: with more seeds it passes more runs, and the result is the same.
BITS_EACH, MOST_BITS = 4, 28
#: Bits that one row of the map holds.
ROW_BITS = 1 << 15


def runs(data: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``lengths``, ascending, a number for so many bytes at each place: exact up to eight, a hash for 16."""
    out = data.astype(np.uint64)
    for q in range(1, min(len(data), WHOLE) + 1):
        if q > 1:
            out = (out[:-1] << np.uint64(8)) | data[q - 1 :]
        if q in lengths:
            yield q, out
    if 2 * WHOLE in lengths and len(data) >= 2 * WHOLE:
        yield 2 * WHOLE, out[:-WHOLE] * np.uint64(0x9E3779B97F4A7C15) + out[WHOLE:]


def places(found: np.ndarray, q: int, bits: int) -> np.ndarray:
    """Where the map of ``2 ** bits`` holds the bit of a run."""
    mixed = (found ^ (found >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(q * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column without nulls, and where each text begins, with the end."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def seeded(bits: int) -> Callable:
    """Patterns with the length and number of their seed, and the bit of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = [p.encode() for p in batch["_low"].to_pylist()]
            lengths = [2 * WHOLE if len(p) >= 2 * WHOLE else min(len(p), WHOLE) for p in lows]
            found = np.array([next(runs(np.frombuffer(p[:q], np.uint8), [q]))[1][0] for p, q in zip(lows, lengths, strict=True)], np.uint64)
            bit = np.array([places(found[i : i + 1], q, bits)[0] for i, q in enumerate(lengths)], np.uint64).astype(np.int64)
            exact = np.array([len(p) <= WHOLE for p in lows], bool)
            yield pa.record_batch([batch["_pattern"], batch["_low"], pa.array(lengths, pa.int32()), pa.array(found.astype(np.int64)), pa.array(bit), pa.array(exact)], ["_pattern", "_low", "_q", "_seed", "_bit", "_whole"])

    return run


def named(held: bytes, bits: int, lengths: list[int]) -> Callable:
    """Of each text the runs that may be seeds, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(held, np.uint8)
        for batch in batches:
            data, begins = text_bytes(batch["_text"])
            for at in range(0, len(data), AT_ONCE):
                part = data[at : at + AT_ONCE + 2 * WHOLE - 1]  # runs that begin before the end of the part
                for q, found in runs(part, lengths):
                    found = found[:AT_ONCE]
                    bit = places(found, q, bits)
                    first = np.flatnonzero((known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                    row = np.searchsorted(begins, first + at, "right") - 1
                    within = first + at + q <= begins[row + 1]
                    row, seed = row[within], found[first[within]]
                    order = np.lexsort((seed, row))
                    row, seed = row[order], seed[order]
                    once = np.ones(len(row), bool)
                    once[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
                    row, seed = row[once], seed[once]
                    if len(row):
                        yield pa.record_batch([batch["_key"].take(pa.array(row)), pa.array(np.full(len(row), q, np.int32)), pa.array(seed.astype(np.int64))], ["_key", "_q", "_seed"])

    return run


def contained(patterns: DataFrame, pattern: str, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct ``(pattern, key)`` of which the text of ``key`` holds the pattern, whatever the case.

    An empty pattern is in every text that is not null, and nulls are in none. Only
    keys and seeds are dealt; texts join the pairs of longer patterns that met. The driver holds the bit map, no pattern.
    """
    spark = patterns.sparkSession
    p = patterns.select(F.col(pattern).alias("_pattern")).where("_pattern is not null").distinct().withColumn("_low", F.lower("_pattern"))
    t = texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where("_text is not null")
    p = written(p, "patterns")
    bits = min(MOST_BITS, max(15, p.count().bit_length() + BITS_EACH))
    seeds = written(p.where(F.length("_low") > 0).mapInArrow(seeded(bits), "_pattern string, _low string, _q int, _seed long, _bit long, _whole boolean"), "seeds")
    rows = seeds.groupBy(F.expr(f"_bit div {ROW_BITS}").alias("at")).agg(F.bitmap_construct_agg(F.col("_bit") % ROW_BITS).alias("bits")).collect()  # 2 ** MOST_BITS bits at most
    held = bytearray(1 << bits - 3)
    for row in rows:
        held[row["at"] * ROW_BITS // 8 : (row["at"] + 1) * ROW_BITS // 8] = row["bits"]
    lengths = sorted(r["_q"] for r in seeds.select("_q").distinct().collect())  # nine at most
    found = t.mapInArrow(named(bytes(held), bits, lengths), f"_key {t.schema['_key'].dataType.simpleString()}, _q int, _seed long")
    met = written(found.join(seeds.drop("_bit"), ["_q", "_seed"]).select("_key", "_pattern", "_low", "_whole"), "met")
    whole = met.where("_whole").select("_pattern", "_key")
    checked = met.where("not _whole").distinct().join(t, "_key").where(F.contains("_text", F.col("_low"))).select("_pattern", "_key")
    everywhere = p.where(F.length("_low") == 0).select("_pattern").limit(1).join(t.select("_key"))
    removed(seeds)
    return whole.unionByName(checked).unionByName(everywhere).distinct().select(F.col("_pattern").alias(pattern), F.col("_key").alias(key))
