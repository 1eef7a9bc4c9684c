"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles. Sets are ordered by one
global order, rare shingles first; two sets of the wanted similarity share a
shingle of their prefixes. Equal sets are one class, and classes of equal prefix
and size one group: only groups enter the prefix index, keyed by shingle. Shingles
of one group alone go; the lists of the others are cut into bands of sizes, so that
all members of a list may match in size.

The join is exact in which documents hang together, without making all pairs of
a list. First each group, and each list, verifies its members against one leader
(as many pairs as members): the one whose shingles are the most frequent, so the
common original of edited copies rather than one of them. Then come the groups of a
list that those links leave in different components: a cluster of copies is one
component by then and makes none. Pairs of groups must pass, inside the join, a
bound on the difference of any two of their members; what passes is expanded to
members, which pass the bound themselves, then an upper bound of the overlap
(bucket counts of the shingles' hashes), and are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_contexts import Index, counted
from .common import in_worker, removed, written
from .components import components

#: Frequent shingles known to the order, at most; they are broadcast. Others count as equally rare.
FREQUENT = 500_000
#: A task reports shingles that it has seen in so many of its documents.
REPORTED = 4
#: Buckets of a class's counts.
BUCKETS = 128
#: Words of 64 parity bits of a class.
PARITY_WORDS = 8
#: Word hashes a worker remembers at most.
MEMO_ENTRIES = 300_000

LEVEL_SHIFT = np.uint64(58)
ODD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hash by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; fewer words are one shingle, none no shingle.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(in_worker("word hashes", _Words).__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(own.tobytes(), seed=len(words))], np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = mixed(out * ODD + own[i : len(out) + i])
    return np.unique(out)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def frequent_shingles(docs: DataFrame, text: str, k: int, bound: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and levels (log2 of the count) of the most frequent shingles, at most ``bound``.

    Counts are of documents and approximate, as a task leaves out what it has seen
    in fewer than ``REPORTED`` of a run of documents. They only shape the order of
    shingles; the join's result does not depend on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, n = counted(np.concatenate(held))
            keys, n = keys[n >= REPORTED], n[n >= REPORTED]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for batch in _slices(batches):
            for value in batch.column(0).to_pylist():
                held.append(shingles(value, k))
                size += len(held[-1])
                if size > 3_000_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    sums = written(docs.select(F.col(f"`{text}`")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "shingle-counts")
    levels = sums.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()
    least, total = None, 0
    for r in levels:
        total += r["k"]
        if total > bound:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    found = sums.where(F.col("n") >= (1 << least)).toArrow()
    n = found.column("n").to_numpy()
    return found.column("h").to_numpy().astype(np.int64).view(np.uint64), np.minimum(np.floor(np.log2(n)), 63).astype(np.uint64)


class Order:
    """The global order of shingles: by level, then by hash."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.index, self.levels = Index(hashes), levels

    def ordered(self, tokens: np.ndarray) -> np.ndarray:
        out = tokens >> np.uint64(6)
        if len(self.levels):
            at = self.index.find(tokens)
            known = at >= 0
            out[known] |= self.levels[at[known]] << LEVEL_SHIFT
        return np.sort(out)


def prefix_sets(docs: DataFrame, id_col: str, text: str, k: int, percent: int, order: Order) -> DataFrame:
    """Per row: ``id``, ``row`` (hash of id and text), ``n``, ``c`` (class), ``g`` (group), ``keys`` (the prefix), ``counts``, ``parity`` and ``rank`` (low where shingles are frequent)."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int32()]
        for batch in _slices(batches):
            cols: list[list] = [[] for _ in range(7)]
            for value in batch.column(2).to_pylist():
                tokens = shingles(value, k)
                n = len(tokens)
                cols[0].append(n)
                if not n:
                    for c in cols[1:]:
                        c.append(None)
                    continue
                ordered = own.ordered(tokens)
                prefix = ordered[: n - -(-percent * n // 100) + 1]
                counts = np.bincount((tokens % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                cols[1].append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                cols[2].append(xxhash.xxh64_intdigest(prefix.tobytes(), seed=n) - (1 << 63))
                cols[3].append(prefix.view(np.int64))
                cols[4].append(counts.astype("<u4" if counts.max() > 65535 else "<u2").tobytes())
                odd = np.bincount((tokens >> np.uint64(7) & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
                cols[5].append(np.packbits(odd.astype(bool)).view(np.int64))
                cols[6].append(-int(1000 * (ordered >> LEVEL_SHIFT).mean()))
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds[2:], strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "row", "n", "c", "g", "keys", "counts", "parity", "rank"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`"))
    return rows.mapInArrow(run, "id long, row long, n long, c long, g long, keys array<long>, counts binary, parity array<long>, rank int")


def _may_match(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose sizes and bucket counts allow the similarity."""
    one = lambda end: classes.select(F.col("c").alias(end), F.col("n").alias(f"n{end}"), F.col("counts").alias(f"s{end}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
            keep = np.ones(len(na), bool)
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                if len(x) == len(y):
                    kind = "<u2" if len(x) == 2 * BUCKETS else "<u4"
                    most = int(np.minimum(np.frombuffer(x, kind), np.frombuffer(y, kind)).sum(dtype=np.int64))
                    keep[i] = 100 * most >= percent * (na[i] + nb[i] - most)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    sized = pairs.join(one("a"), "a").join(one("b"), "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` whose sets have the similarity, exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            keep = np.ones(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """``(c, s)``: the shingles of the wanted classes, made again from one of their texts."""
    rows = classes.join(wanted, "c", "left_semi").select("row", "c")
    keyed = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 500):
            found = [shingles(t, k) for t in batch.column(1).to_pylist()]
            real = [xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(real, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["c", "real", "s"])

    made = keyed.join(rows, "row").select("c", "_text").mapInArrow(run, "c long, real long, s binary").where("c = real")
    return made.groupBy("c").agg(F.first("s").alias("s"))


def _normal(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()


def _far(x: str, y: str) -> Column:
    """Parity bits in which members of two groups differ at least, from the bits that all and that any of their members have set."""
    words = [(F.col(f"{x}.all{i}").bitwiseAND(F.bitwise_not(f"{y}.any{i}"))).bitwiseOR(F.col(f"{y}.all{i}").bitwiseAND(F.bitwise_not(f"{x}.any{i}"))) for i in range(PARITY_WORDS)]
    return sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0])).cast("long")


def _open_pairs(entries: DataFrame, classes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of classes in different components that share a list or a group and pass the parity bound.

    Group pairs come first, filtered by what holds of all their members; the rest is
    expanded to classes, which are filtered one by one. A difference of d shingles
    flips at most d parity bits.
    """
    parity = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY_WORDS)]
    member = classes.select("g", "c", "n", *parity).join(known.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")
    sums = [f(f"p{i}").alias(f"{name}{i}") for i in range(PARITY_WORDS) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
    whole = member.groupBy("g").agg(F.min("n").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), *sums)
    whole = written(whole, "group-bounds")
    spans = entries.join(whole.select("g", "c1", "c2"), "g")
    open_ = spans.groupBy("key").agg(F.min("c1").alias("x"), F.max("c2").alias("y")).where("x <> y").select("key")
    listed = written(entries.join(open_, "key", "left_semi").join(whole, "g"), "open-lists")

    x, y = listed.alias("x"), listed.alias("y")
    apart = (F.col("x.c1") != F.col("y.c2")) | (F.col("x.c2") != F.col("y.c1"))
    may = _far("x", "y") * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    between = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") < F.col("y.g")) & apart & may).select(F.col("x.g").alias("gx"), F.col("y.g").alias("gy")).distinct()
    inside = whole.where("c1 <> c2").select(F.col("g").alias("gx"), F.col("g").alias("gy"))
    end = lambda e: member.select(*[F.col(c).alias(f"{c}{e}") for c in member.columns])
    both = between.unionByName(inside).join(end("x"), "gx").join(end("y"), "gy")
    differ = sum((F.bit_count(F.col(f"p{i}x").bitwiseXOR(F.col(f"p{i}y"))) for i in range(1, PARITY_WORDS)), F.bit_count(F.col("p0x").bitwiseXOR(F.col("p0y"))))
    near = differ.cast("long") * (100 + percent) <= (F.col("nx") + F.col("ny")) * (100 - percent)
    pairs = written(_normal(both.where((F.col("compx") != F.col("compy")) & near).select(F.col("cx").alias("a"), F.col("cy").alias("b"))), "pairs2")
    removed(whole, listed)
    return pairs


def _resolved(docs: DataFrame, id_col: str, text: str, k: int, percent: int) -> DataFrame:
    """Per row: ``id``, ``row``, ``n``, class ``c``, ``component`` (its least class) and ``component_id``; the last three null without shingles.

    Every table on the way is removed as soon as the next ones are written.
    """
    order = Order(*frequent_shingles(docs, text, k))
    found = written(prefix_sets(docs, id_col, text, k, percent, order), "prefix-sets")
    some = found.where("n > 0")
    classes = some.groupBy("c").agg(F.min("id").alias("least_id"), F.min("row").alias("row"), F.min("g").alias("g"), F.min("n").alias("n"), F.min("rank").alias("rank"))
    classes = written(classes.join(some.select("row", "c", "counts", "parity").dropDuplicates(["row", "c"]), ["row", "c"]), "classes")
    groups = classes.groupBy("g").agg(F.min_by("c", F.struct("rank", "c")).alias("lead"), F.count(F.lit(1)).alias("members"), F.min("n").alias("n"), F.min("rank").alias("rank"))
    groups = written(groups, "groups")

    # Lists of the prefix index with two groups at least, by band of sizes, and their leading group.
    tokens = some.dropDuplicates(["g"]).select("g", F.explode("keys").alias("token"))
    several = tokens.groupBy("token").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("token")
    width = math.log(100 / percent) * 1.000001 + 1e-9  # of a band; a match is in the same band or the next
    band = F.floor(F.log("n") / width)
    index = tokens.join(several, "token").join(groups.select("g", "n", "rank"), "g")
    index = written(index.select("g", "rank", F.explode(F.array(F.xxhash64("token", band), F.xxhash64("token", band + 1))).alias("key")), "prefix-index")
    rows = written(found.select("id", "row", "n", "c"), "rows")
    removed(found)
    lists = index.groupBy("key").agg(F.min(F.struct("rank", "g")).alias("lo"), F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 <> g2").select("key", F.col("lo.g").alias("lo"))
    entries = written(index.join(lists, "key").drop("rank"), "entries")
    removed(index)

    # First round: leaders.
    inside = classes.join(groups.where("members > 1"), "g").select(F.col("lead").alias("a"), F.col("c").alias("b"))
    between = entries.where("g <> lo").select("lo", "g").distinct()
    between = between.join(groups.select(F.col("g").alias("lo"), F.col("lead").alias("a")), "lo").join(groups.select("g", F.col("lead").alias("b")), "g").select("a", "b")
    tried = written(_normal(inside.unionByName(between)), "pairs1")
    likely = written(_may_match(tried, classes, percent), "likely1")
    sets = written(_sets_of(_ends(likely), classes, docs, id_col, text, k), "sets1")
    links = written(_verified(likely, sets, percent), "links1")
    removed(likely, sets)

    # Second round: members of a list that are not in one component yet.
    known = components(links)
    pairs = _open_pairs(entries.select("key", "g"), classes, known, percent)
    likely = written(_may_match(pairs.join(tried, ["a", "b"], "left_anti"), classes, percent), "likely2")
    removed(entries, groups, tried, pairs)
    if not likely.isEmpty():
        sets = written(_sets_of(_ends(likely), classes, docs, id_col, text, k), "sets2")
        more = written(_verified(likely, sets, percent), "links2")
        removed(sets, known)
        known = components(links.unionByName(more))
        removed(more)

    joined = classes.select("c", "least_id").join(known.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    named = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    out = written(rows.join(joined.join(named, "component").select("c", "component", "component_id"), "c", "left"), "resolved")
    removed(rows, classes, likely, links, known)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links, its own included.

    Two rows link when ``100 * |intersection| >= percent * |union|`` of their sets of
    ``k``-word shingles. A null text, or one without words, has an empty set and
    links with nothing. Equal texts, also with equal or null ids, are one class; a
    component's id is its least id that isn't null. An empty table gives no rows.
    """
    rows = _resolved(docs, id_col, text, k, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which each component keeps one: that of the least id (null ids come last).

    Rows without words stay all. Of rows equal in id and text one stays.
    """
    rows = _resolved(docs, id_col, text, k, percent)
    least = rows.where("n > 0").groupBy("component").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row"))
    stay = least.select("row", F.lit(True).alias("one")).unionByName(rows.where("n = 0").select("row", F.lit(False).alias("one")).distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias("row"))
    kept = whole.join(stay, "row")
    return kept.where("one").dropDuplicates(["row"]).unionByName(kept.where("not one")).select("doc.*")
