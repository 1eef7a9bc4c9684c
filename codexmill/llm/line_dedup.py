"""Line deduplication over levelled sorted runs of line hashes.

The state is a log-structured set of runs: tables ``(h1, h2, n)`` bucketed and
sorted by the 128-bit hash of a line's key, one sorted file a bucket. ``n`` is the
number of documents so far that hold the line, so the newest entry of a key is its
largest. A new batch is aggregated to a table of the same buckets and order, and
merged with every run: keys that a run has as frequent go (merge-anti-join), the
others take up the count that the runs have, and what is left is the batch's own
run on level 0. When a level has ``fanout`` runs they are compacted to one of the
next level. All of it works bucket by bucket, joins being merges of sorted
files: neither runs nor batches are shuffled, sorted or counted again.

Only DataFrame functions are used: no text is shuffled for counting, only
hashes pre-aggregated on the map side, so a line held by a third of all
documents costs one row per task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CLEANUP, ascii_lower, delete, new_path, setting, written

#: ASCII white space that is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of every line. Lambdas are not compiled, so each step is its own transform and computed once a line."""
    stripped = F.transform(lines_of(text), lambda line: F.btrim(line, F.lit(SPACE)))
    # lower() has a fast way for ASCII, where it changes A-Z alone; other lines are translated.
    return F.transform(stripped, lambda line: F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(ascii_lower(line)))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """``struct(h1, h2)`` of each distinct key of at least ``min_chars`` characters.

    Keys are made distinct as strings, by a hash set; structs would be compared in pairs.
    """
    return F.transform(F.array_distinct(F.filter(line_keys(text), lambda key: F.char_length(key) >= min_chars)), key_hash)


class LineRuns:
    """Levelled runs of line hashes with document counts.

    ``min_docs``: a key found in so many documents is frequent.
    ``min_chars``: shorter keys are never counted.
    ``fanout``: runs of one level that are compacted into one of the next.
    ``buckets``: of every run; by default the session's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 2, buckets: int | None = None):
        if min_docs < 1 or fanout < 2:
            raise ValueError("min_docs must be at least 1 and fanout at least 2")
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def count(self, docs: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
        """``(h1, h2, n)`` of the documents, one count a row and key (``by``: kept apart by that column)."""
        hashes = line_hashes(F.col(f"`{text}`"), self.min_chars)
        kept = [F.col(by)] if by else []
        exploded = docs.select(*kept, F.explode(hashes).alias("h")).select(*kept, "h.h1", "h.h2")
        return exploded.groupBy(*kept, "h1", "h2").agg(F.count(F.lit(1)).alias("n"))

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Adds a new batch of documents; what came before is read as runs, not counted again."""
        batch = self.store(self.count(docs, text), "batch")
        self.add_counts(self.spark.table(batch))
        self.drop(batch)

    def add_counts(self, batch: DataFrame) -> None:
        """Adds the counts of a batch, bucketed as the runs are."""
        runs = [self.spark.table(r) for level in self.levels for r in level]
        for run in runs:
            batch = batch.join(run.where(F.col("n") >= self.min_docs).hint("merge"), ["h1", "h2"], "left_anti")
        for i, run in enumerate(runs):
            batch = batch.join(run.withColumnRenamed("n", f"n{i}").hint("merge"), ["h1", "h2"], "left")
        seen = F.greatest(F.lit(0), *[F.col(f"n{i}") for i in range(len(runs))]) if runs else F.lit(0)
        own = batch.select("h1", "h2", (F.col("n") + seen).alias("n"))
        self.levels[0].append(self.store(own, "run0", placed=True))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            full, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self.store(self.newest(full), f"run{level + 1}", placed=True))
            self.drop(*full)
            level += 1

    def newest(self, runs: list[str]) -> DataFrame:
        """The last count of every key of the runs, bucket by bucket."""
        out = self.spark.table(runs[0])
        for other in runs[1:]:
            out = out.unionByName(self.spark.table(other))
        return out.groupBy("h1", "h2").agg(F.max("n").alias("n"))

    def frequent_keys(self) -> DataFrame:
        """All keys found in at least ``min_docs`` of the documents added so far, written to the shared folder."""
        runs = [r for level in self.levels for r in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        with self.merging():
            return written(self.newest(runs).where(F.col("n") >= self.min_docs).select("h1", "h2"), "frequent")

    def merging(self):
        """Lets the order of a bucket's only file stand for a sort."""
        return setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def store(self, counts: DataFrame, name: str, by: str | None = None, placed: bool = False) -> str:
        """``counts`` as a bucketed, sorted table; ``placed`` if the rows are in their buckets already."""
        table, path = f"codexmill_{name}_{uuid.uuid4().hex}", new_path(self.spark, name)
        if not placed:
            counts = counts.repartition(self.buckets, "h1", "h2")
        writer = counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path)
        with self.merging(), setting(self.spark, CLEANUP, "true"):
            (writer.partitionBy(by) if by else writer).saveAsTable(table)
        self.paths[table] = path
        return table

    def drop(self, *tables: str) -> None:
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")
            delete(self.spark, self.paths.pop(table))

    def close(self) -> None:
        """Drops all runs."""
        self.drop(*[r for level in self.levels for r in level])
        self.levels = [[]]


def drop_lines(docs: DataFrame, frequent: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; input columns of these names are replaced.

    Lines whose key is in ``frequent`` go; the others stay in order, joined by a
    line feed. What a row loses depends on its text alone, so the places of
    frequent lines are looked up per hash of id and text and joined back; equal rows
    share the lookup. ``kept_text`` is empty where every line goes, and for a null
    text. A text's work grows with its number of lines, however many of them are
    frequent. Other columns stay as they are, whatever their names.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    whole = F.col(f"`{text}`")
    keys = [F.xxhash64(F.col(f"`{id_col}`"), whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")]
    # Hashes of the text come before the explode, which would take the text along and hash it for each line.
    asked = docs.select(*keys, F.transform(line_keys(whole), lambda key: F.when(F.char_length(key) >= min_chars, key_hash(key))).alias("lines"))
    asked = asked.select("k1", "k2", F.posexplode("lines").alias("at", "h")).where("h is not null").select("k1", "k2", "at", "h.h1", "h.h2")
    hot = asked.join(frequent, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("at").alias("hot"))
    rows = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # A column by itself, as a lambda would split the text again for each line.
    joined = rows.join(hot, ["k1", "k2"], "left").select("doc", "hot", lines_of(F.col(f"doc.`{text}`")).alias("lines"))
    # array_except works by hash sets, so places are taken out in one pass.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("hot", F.array().cast("array<int>")))
    left = F.transform(places, lambda at: F.get(F.col("lines"), at))
    return joined.select(
        *[F.col(f"doc.`{c}`") for c in kept],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("hot").isNull(), 0).otherwise(F.size("hot")).cast("long").alias("n_dropped"),
        F.array_join(left, "\n").alias("kept_text"),
    )


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drops every line whose key is found in at least ``min_docs`` documents.

    A key is the line with ASCII white space stripped at both ends and A-Z
    lower-cased. Each row counts as one document, also where ids or texts
    repeat; a null text is one empty line; an empty table gives no rows; extra
    columns are kept, whatever their names.

    The documents come as ``batches`` batches (by hash of the id and the text); one
    scan counts each batch by itself, and their counts enter the runs one after the
    other. The result does not depend on the number of batches.
    """
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    batch = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text}`")), F.lit(batches)).cast("int")
    counts = runs.count(docs.select(F.col(f"`{text}`").alias("text"), batch.alias("batch")), "text", "batch")
    counted = runs.store(counts, "batches", "batch")
    for b in range(batches):
        runs.add_counts(docs.sparkSession.table(counted).where(F.col("batch") == b).drop("batch"))
    frequent = runs.frequent_keys()
    runs.drop(counted)
    runs.close()
    return drop_lines(docs, frequent, text, id_col, min_chars)
