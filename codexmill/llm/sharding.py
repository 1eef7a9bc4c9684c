"""Shards of near equal bytes by sampled splitters.

The law is ``bytes``: shards are ranges of the text's hash that hold near equal
numbers of bytes. Splitters are quantiles of a size-weighted sample of keys;
they cut the key space into ``n_shards * ranges_per_shard`` ranges of about
equal size. A range that turns out overfull is subdivided by key; only a key that is
larger than a piece by itself (a text with very many copies) is split by a hash of
the id. The exact bytes and rows of each piece, of which there are boundedly many,
then decide which shard takes it and where its slots begin.

Equal texts have equal keys and so stay together unless they are such a key.

Only DataFrame functions are used. After the first scan only ids, sizes and
hashes move; no task numbers more than the rows of one piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written

#: Keys drawn for each range.
DRAWS_PER_RANGE = 32


def sizes(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Id, ``size`` (UTF-8 bytes of the text and 1 more; a null text is 1), ``text_crc32`` and keys."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).cast("long").alias("text_crc32"),
        F.xxhash64(whole).alias("_key"),
    )


def splitters(keyed: DataFrame, n_ranges: int, total: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys, at most ``n_ranges - 1``.

    Each row is drawn ``size * draws / total`` times on average (the fraction by a
    hash of the row), so the sample has about ``n_ranges * DRAWS_PER_RANGE`` keys,
    however large the table; so many come to the driver, which picks the boundaries.
    """
    draws = n_ranges * DRAWS_PER_RANGE
    chance = F.pmod(F.xxhash64(F.lit(11), "_id", "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(F.col("size") * F.lit(draws / max(total, 1)) + chance)
    sample = keyed.select("_key", drawn.cast("long").alias("_n")).where("_n > 0").groupBy("_key").agg(F.sum("_n").alias("_n"))
    ordered = sample.collect()  # at most about n_ranges * DRAWS_PER_RANGE keys
    ordered.sort(key=lambda r: r["_key"])
    weight, cuts, seen = sum(r["_n"] for r in ordered), [], 0
    for r in ordered:
        # A key enters the range below a boundary if the keys up to it fill that range.
        seen += r["_n"]
        while len(cuts) < n_ranges - 1 and seen * n_ranges >= weight * (len(cuts) + 1):
            cuts.append(r["_key"])
    return sorted(set(cuts))


def range_of(key, cuts: list[int]):
    """Number of boundaries below the key, found in two steps of about the square root of their count."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    tops = F.array(*[F.lit(b[-1]) for b in blocks])
    inner = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    coarse = F.size(F.filter(tops, lambda s: s < key))
    fine = F.size(F.filter(F.get(inner, coarse), lambda s: s < key))
    return F.least(F.lit(len(cuts)), coarse * step + F.coalesce(fine, F.lit(0))).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text: str = "text", ranges_per_shard: int = 64, rows_per_piece: int = 1_000_000) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``law`` is ``bytes`` and ``grown_shard`` null, as this law moves rows when a
    shard is added. Slots are gapless from 0 in each shard. A null text counts as
    empty; null and repeated ids are rows like others (of fully equal rows it is
    undefined which gets which of their slots); an empty table gives no rows.
    """
    keyed = written(sizes(docs, id_col, text), "sizes")
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()["b"]
    n_ranges = n_shards * ranges_per_shard
    cuts = splitters(keyed, n_ranges, total)
    ranged = keyed.withColumn("_range", range_of(F.col("_key"), cuts))

    # Ranges, and keys that are larger than a range should be, are at most n_ranges rows
    # (and one for each rows_per_piece rows): how many pieces each needs.
    share = max(1.0, total / n_ranges)
    sums = [F.sum("size").alias("_b"), F.count(F.lit(1)).alias("_r")]
    pieces_of = F.greatest(F.when(F.col("_b") > 1.5 * share, F.ceil(F.col("_b") / share)).otherwise(1), F.ceil(F.col("_r") / rows_per_piece), F.lit(1)).cast("int")
    ranges = written(ranged.groupBy("_range").agg(*sums), "ranges")
    overfull = ranges.where((F.col("_b") > 1.5 * share) | (F.col("_r") > rows_per_piece)).select("_range")
    heavy = ranged.join(F.broadcast(overfull), "_range", "left_semi").groupBy("_range", "_key").agg(*sums).where((F.col("_b") > share) | (F.col("_r") > rows_per_piece))
    heavy = written(heavy.select("_range", "_key", "_b", "_r", pieces_of.alias("_parts")), "heavy-keys")
    taken = heavy.groupBy("_range").agg(F.sum("_b").alias("_hb"), F.sum("_r").alias("_hr"))
    light = ranges.join(taken, "_range", "left").select("_range", (F.col("_b") - F.coalesce("_hb", F.lit(0))).alias("_b"), (F.col("_r") - F.coalesce("_hr", F.lit(0))).alias("_r"))
    ends = [-(2**63), *cuts, 2**63]
    bounds = docs.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False))], "_range int, _lo double, _hi double")
    parts = light.select("_range", pieces_of.alias("_subs")).join(bounds, "_range")
    # Keys are hashes, so equal steps of the key are near equal shares of a range.
    sub = F.least(F.floor((F.col("_key") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_subs")), F.col("_subs") - 1).cast("int")
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(5), "_id"), F.col("_parts")).cast("int"), F.lit(-1))
    pieced = ranged.join(F.broadcast(parts), "_range").join(F.broadcast(heavy.select("_key", "_parts")), "_key", "left")
    pieced = written(pieced.select("_id", "size", "text_crc32", "_key", "_range", sub.alias("_sub"), F.when(F.col("_parts").isNotNull(), F.col("_key")).otherwise(0).alias("_own"), part.alias("_part")), "pieces")
    removed(ranges, heavy, keyed)

    # Pieces are at most 3 * n_ranges + 2 * rows / rows_per_piece.
    piece = ["_range", "_sub", "_own", "_part"]
    along = Window.orderBy(*piece)
    pieces = pieced.groupBy(*piece).agg(*sums)
    placed = pieces.withColumn("_before", F.sum("_b").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_b"))
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("_before") + F.col("_b") / 2) * n_shards / F.lit(max(total, 1)))).cast("int"))
    inside = Window.partitionBy("shard").orderBy(*piece).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("_first", F.sum("_r").over(inside) - F.col("_r")).select(*piece, "shard", "_first")

    numbered = pieced.withColumn("_nth", F.row_number().over(Window.partitionBy(*piece).orderBy("_key", "_id", "size")))
    return numbered.join(F.broadcast(placed), piece).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

