"""A stored BM25 index of blocks, and searches that read only blocks that can matter.

Documents are dealt into ranges of ids; a block holds the postings of one term in
one range, with their weights and the largest of them. A query's bound for a range is
the sum of its terms' largest weights there, so no document of the range scores
more. A search scores the most promising ranges of each query, which gives the
query a threshold, and then only ranges whose bound reaches it; the others' postings
are never read. Results are those of a full search.

Blocks are partitioned on disk by a hash of the term, and their bounds are read
without their postings. A frequent term has as many blocks as there are ranges,
so no row grows with the corpus.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import ARROW_ROWS, removed, setting, written
from ..sources.readers import save_manifest, stored_count

K1, B = 1.5, 0.75
#: Folders of the index; terms are dealt into them by hash.
FOLDERS = 32
#: Postings that a task sorts at once, and products of a term's factor and weight that it adds at once, about; only bound memory.
AT_ONCE, PRODUCTS = 1 << 19, 1 << 22
#: Queries that are scored together in a range, about; only bounds memory.
TOGETHER = 256


@dataclass(frozen=True)
class Blocks:
    """A stored index: ``terms(folder, term, idf)`` and ``blocks(folder, term, range, most, n, postings)``."""

    spark: SparkSession
    path: str

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def block_rows(length: float) -> Callable:
    """Documents in order of their range as blocks; a range is held whole, about ``AT_ONCE`` postings at a time are sorted."""
    scale = max(length, 1e-9)

    def blocks(rows: pa.RecordBatch) -> pa.RecordBatch:
        terms, held = rows["terms"], rows["terms"].value_lengths().to_numpy()
        code = terms.flatten().dictionary_encode()
        row, tf = np.repeat(np.arange(len(held)), held), rows["tfs"].flatten().to_numpy()
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * rows["dl"].to_numpy()[row] / scale))
        key = rows["key"].dictionary_encode().indices.to_numpy()[row] * len(code.dictionary) + code.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        n, at = np.diff(np.r_[first, len(order)]), order[first]
        entries = pa.StructArray.from_arrays([rows["id"].take(pa.array(row[order])), pa.array(weight[order])], ["id", "w"])
        postings = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), entries)
        columns = [code.dictionary.take(code.indices.take(pa.array(at))), rows["range"].take(pa.array(row[at])), pa.array(np.maximum.reduceat(weight[order], first)), pa.array(n.astype(np.int64)), postings]
        return pa.record_batch(columns, ["term", "range", "most", "n", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # of the range that the next batch may go on with
        for batch in itertools.chain((b for b in batches if b.num_rows), [None]):
            if batch is not None and (not left or left[-1]["key"][-1] == batch["key"][0] == batch["key"][-1]):
                left.append(batch)
                continue
            rows = pa.concat_batches(left + ([batch] if batch is not None else [])) if left else None
            if rows is None:
                return
            key = rows["key"].dictionary_encode().indices.to_numpy()
            begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            upto = np.r_[0, np.cumsum(rows["terms"].value_lengths().to_numpy())][begins]
            done = len(begins) - (1 if batch is None else 2)  # ranges that have ended
            i = 0
            while i < done:
                j = max(i + 1, min(done, int(np.searchsorted(upto, upto[i] + AT_ONCE, "right")) - 1))
                yield blocks(rows.slice(begins[i], begins[j] - begins[i]))
                i = j
            left = [rows.slice(begins[done])] if batch is not None else []

    return run


def build(postings: DataFrame, n_docs: int, path: str, width: int = 512, cluster: str | None = None) -> Blocks:
    """Writes ``postings(id, term, tf, dl)`` of ``n_docs`` documents as blocks of a range of documents each."""
    rows = postings.groupBy("id", "dl", *([cluster] if cluster else [])).agg(F.collect_list(F.struct("term", "tf")).alias("t"))  # terms of a document
    return build_counted(rows.select("*", F.col("t.term").alias("terms"), F.col("t.tf").alias("tfs")), n_docs, path, width, cluster)


def build_counted(docs: DataFrame, n_docs: int, path: str, width: int = 512, cluster: str | None = None) -> Blocks:
    """Writes ``docs(id, dl, terms, tfs)``, a row a document, as blocks of a range of documents each.

    A range holds those of ``width`` consecutive integer ids that are alike: of one
    value of ``cluster`` (a language, a source) and of lengths within a factor of two.
    Alike documents share terms and weights, so their bound is closer to their scores.
    Documents are dealt whole by their range, so no posting is dealt on its own.
    """
    spark = docs.sparkSession
    place = F.struct(*([F.col(cluster).cast("string").alias("of")] if cluster else []), F.floor(F.log2("dl")).alias("length"), F.floor(F.col("id") / width).alias("at"))
    d = written(docs.where(F.size("terms") > 0).select("id", F.col("dl").cast("long").alias("dl"), "terms", "tfs", place.alias("range")), "counted")
    length = (d.select(F.explode("tfs").alias("tf")).agg(F.sum("tf")).first()[0] or 0) / n_docs if n_docs else 1.0
    dealt = d.withColumn("key", F.to_json("range")).repartition("key").sortWithinPartitions("key")
    kinds = {c: d.schema[c].dataType.simpleString() for c in ("id", "range")}
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        blocks = dealt.mapInArrow(block_rows(length), f"term string, range {kinds['range']}, most double, n long, postings array<struct<id: {kinds['id']}, w: double>>")
        blocks.withColumn("folder", folder(F.col("term"))).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    df = F.sum("n")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("folder", "term").agg(F.log(1 + (n_docs - df + 0.5) / (df + 0.5)).alias("idf"))
    terms.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/terms")
    removed(d)
    save_manifest(spark, path, n_docs)
    return Blocks(spark, path)


def stored(spark: SparkSession, path: str, n_docs: int) -> Blocks | None:
    return Blocks(spark, path) if stored_count(spark, path) == n_docs else None


def range_scores(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
    """Scores of a range's documents in each query of ``wanted(query_id, floor)`` that reach its floor, of ``blocks(postings, queries, factors)``."""
    asked, flat = wanted["query_id"].combine_chunks(), blocks["postings"].combine_chunks().flatten()
    ids, weight = flat.field("id").dictionary_encode(), flat.field("w").to_numpy()
    doc, held = ids.indices.to_numpy(), pc.list_value_length(blocks["postings"]).to_numpy()
    code = pc.fill_null(pc.index_in(blocks["queries"].combine_chunks().flatten(), value_set=asked), -1).to_numpy()
    own = code >= 0
    row = np.repeat(np.arange(len(held)), pc.list_value_length(blocks["queries"]).to_numpy())[own]
    code, factor = code[own].astype(np.int64), blocks["factors"].combine_chunks().flatten().to_numpy()[own]
    n, first = held[row].astype(np.int64), (np.cumsum(held) - held)[row]
    upto, width, i = np.r_[0, np.cumsum(n)], len(ids.dictionary), 0
    score = np.zeros(len(asked) * width)
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + PRODUCTS, "right")) - 1)
        at = np.repeat(np.arange(i, j), n[i:j])
        entry = np.arange(upto[i], upto[j]) - upto[at] + first[at]
        score += np.bincount(code[at] * width + doc[entry], factor[at] * weight[entry], len(score))
        i = j
    score, floor = score.reshape(len(asked), width), wanted["floor"].to_numpy()
    query, found = np.nonzero((score > 0) & ~(score < floor[:, None]))  # a null is no floor
    return pa.table([asked.take(pa.array(query)), ids.dictionary.take(pa.array(found)), pa.array(score[query, found])], ["query_id", "id", "score"])


@dataclass(frozen=True)
class Search:
    """Results and what they took: ``found(query_id, id, score, rank)``, ``read`` and ``full``: postings read, and those of a full search."""

    found: DataFrame
    read: int
    full: int


def search(index: Blocks, asked: DataFrame, top: int, first: int = 4) -> Search:
    """The best ``top`` documents of each query of ``asked(query_id, term, times)``, rank from 0, ties by id; only positive scores. A null is a query too.

    ``first`` ranges of each query are scored before the threshold is set.
    """
    by_query = lambda *c: Window.partitionBy("query_id").orderBy(*c)
    q = written(asked.withColumn("folder", folder(F.col("term"))).join(index.terms(), ["folder", "term"]).select("folder", "term", "query_id", (F.col("times") * F.col("idf")).alias("factor")), "asked")
    heads = index.blocks().select("folder", "term", "range", "most", "n").join(q, ["folder", "term"])
    bounds = heads.groupBy("query_id", "range").agg(F.sum(F.col("factor") * F.col("most")).alias("bound"), F.sum("n").alias("n"))
    bounds = written(bounds.withColumn("nth", F.row_number().over(by_query(F.col("bound").desc(), "range"))), "bounds")

    parts = max(1, -(-q.select("query_id").distinct().count() // TOGETHER))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
    asks = q.groupBy("folder", "term", part).agg(F.collect_list(F.struct("query_id", "factor")).alias("asks"))
    asks = written(asks.select("folder", "term", "part", F.col("asks.query_id").alias("queries"), F.col("asks.factor").alias("factors")), "asks")  # of a known size, so a small one goes to the blocks
    types = {f.name: f.dataType.simpleString() for f in [q.schema["query_id"], *index.blocks().schema["postings"].dataType.elementType.fields]}

    def scored(ranges: DataFrame) -> DataFrame:
        """A block is dealt once for all queries that ask its term, and its postings are met where its range lies."""
        wanted = ranges.select("range", part, "query_id", "floor")
        hits = index.blocks().select("folder", "term", "range", "postings").join(asks, ["folder", "term"]).select("range", "part", "postings", "queries", "factors")
        hits = hits.join(wanted, ["range", "part"], "left_semi")
        return hits.groupBy("range", "part").cogroup(wanted.groupBy("range", "part")).applyInArrow(range_scores, f"query_id {types['query_id']}, id {types['id']}, score double")

    ranked = lambda s: s.withColumn("rank", F.row_number().over(by_query(F.round("score", 9).desc(), "id"))).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1)
    begun = written(ranked(scored(bounds.where(F.col("nth") <= first).withColumn("floor", F.lit(None).cast("double")))), "best")
    floors = begun.where(F.col("rank") == top - 1).select("query_id", (F.col("score") - 1e-6).alias("floor"))  # sums in another order may differ in their last digits
    later = bounds.where(F.col("nth") > first).join(floors, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))
    later = written(later.select("query_id", "range", "n", "floor"), "ranges")
    found = written(ranked(begun.drop("rank").unionByName(scored(later))), "lexical")
    full, read = bounds.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("nth") <= first, F.col("n"))), F.lit(0))).first()
    read += later.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    removed(q, asks, bounds, begun, later)
    return Search(found, read, full)
