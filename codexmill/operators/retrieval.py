"""Batch retrieval: BM25, cosine, rank fusion, boosts, assembly.

All operators take a table of queries (``query_id``), never one string, and keep
every ranking total. BM25 joins query terms to a postings table, so its work
grows with the lists of the terms asked, not with the number of documents.
"""

from __future__ import annotations

import collections
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semi import optional as optional_field
from ..scratch import written
from .vectors import bucketed, exact

K1, B = 1.5, 0.75
RRF_CONSTANT = 60
LEXICAL_TOP, DENSE_LEAST = 24, 24

#: Function words that the tokeniser leaves out.
STOP_WORDS = (
    "yang dan di ke dari dalam atau atas untuk dengan pada adalah ini itu juga tidak akan telah sebagai dapat "
    "oleh karena bagi lebih satu dua ia dia kami kita mereka ada pun hanya saja agar jika bila masih sudah belum no nr uu"
).split()


def tokens(text: Column) -> Column:
    """Lower-cased runs of ``[a-z0-9]`` without stop words; other letters split tokens."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """``(id, term, tf, dl)`` and columns ``more`` of the document: the inverted index, one row a document and term."""
    own = docs.select(F.col(id_col).alias("id"), *more, tokens(F.col(text)).alias("t"))
    exploded = own.select("id", *more, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return exploded.groupBy("id", *more, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def counted(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """``(id, dl, terms, tfs)`` and columns ``more``: the terms of ``postings``, a row a document, counted where the text lies. Ids are unique."""
    stops = frozenset(STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile("[a-z0-9]+").findall
        for batch in batches:
            rows = [collections.Counter(found(t)) for t in batch["_low"].to_pylist()]
            for row in rows:
                for stop in stops & row.keys():
                    del row[stop]
            ends = pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(rows)), pa.string())), pa.ListArray.from_arrays(ends, pa.array(list(itertools.chain.from_iterable(r.values() for r in rows)), pa.int64())))
            own = [pa.array([r.total() for r in rows], pa.int64()), *lists]
            yield pa.record_batch([batch["id"], *[batch[c] for c in more], *own], ["id", *more, "dl", "terms", "tfs"])

    own = docs.select(F.col(id_col).alias("id"), *more, F.lower(F.coalesce(text, F.lit(""))).alias("_low"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "_low")
    return own.mapInArrow(run, f"{kept}, dl long, terms array<string>, tfs array<long>")


def asked_terms(queries: DataFrame, query_text: str = "text") -> DataFrame:
    """``(query_id, term, times)``."""
    return queries.select("query_id", F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text", query_text: str = "text", top: int = LEXICAL_TOP, index: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score, rank)``: the best ``top`` documents of each query, rank from 0, ties by id.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); N and the mean length are over all
    documents, those without tokens included (1.0 for no documents). A query term
    counts as often as it is asked. Only positive scores are returned. ``index`` is
    a stored ``postings`` table, made here if absent.
    """
    p = index if index is not None else postings(docs, id_col, text)
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(tokens(F.col(text)))), F.lit(1.0)).alias("avgdl"))
    asked = asked_terms(queries, query_text)
    hits = p.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").join(asked, "term").join(F.broadcast(size))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.greatest("avgdl", F.lit(1e-9)))
    scored = scored.groupBy("query_id", "id").agg(F.sum(F.col("times") * idf * F.col("tf") * (K1 + 1) / norm).alias("score")).where("score > 0")
    return ranked(scored, "score", top)


def ranked(scored: DataFrame, score: str, top: int) -> DataFrame:
    """``rank`` from 0 by score (to 9 decimals, so that sums in another order tie alike), then id."""
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 if a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def dense(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, query_vector: str = "vector", top: int = DENSE_LEAST) -> DataFrame:
    """``(query_id, id, score, rank)`` by exact cosine of a batch of queries against all vectors, in blocks of queries."""
    return exact(queries, vectors, id_col, vector, query_vector, top)


def lsh_planes(spark: SparkSession, planes: int, width: int) -> np.ndarray:
    """Random hyperplanes, whose signs come from a hash of plane and dimension."""
    at = spark.range(planes * width).select(F.col("id"), F.xxhash64((F.col("id") / width).cast("int"), (F.col("id") % width).cast("int")).alias("h"))
    signs = at.orderBy("id").select(F.when(F.col("h") % 2 == 0, 1.0).otherwise(-1.0).alias("sign")).toArrow()  # a number for each plane and dimension
    return signs["sign"].to_numpy().reshape(planes, width)


def dense_lsh(queries: DataFrame, vectors: DataFrame, id_col: str, vector: str, width: int, bits: int = 4, tables: int = 24, top: int = DENSE_LEAST) -> DataFrame:
    """Like ``dense`` among the vectors that share a bucket with the query; scores are exact, recall is not.

    A query with fewer than ``top`` bucket mates is asked of all vectors.
    """
    planes = lsh_planes(queries.sparkSession, bits * tables, width)
    found = written(bucketed(queries, vectors, id_col, vector, planes, bits, top=top), "lsh")
    full = found.where(F.col("rank") == top - 1).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    return found.join(full, "query_id", "left_semi").unionByName(dense(short, vectors, id_col, vector, top=top))


def fuse(lists: list[DataFrame], boosts: DataFrame | None = None) -> DataFrame:
    """``(query_id, id, score)``: sums of 1 / (60 + rank), ranks from 0; boosts only raise ids in a list."""
    both = lists[0].select("query_id", "id", "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select("query_id", "id", "rank"))
    fused = both.groupBy("query_id", "id").agg(F.sum(1 / (RRF_CONSTANT + F.col("rank"))).alias("score"))
    if boosts is None:
        return fused
    total = boosts.groupBy("query_id", "id").agg(F.sum("boost").alias("boost"))
    return fused.join(total, ["query_id", "id"], "left").select("query_id", "id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))


def usage_boosts(feedback: DataFrame, keys: list[str], cited: Column) -> DataFrame:
    """``keys`` and ``boost``: 0.002 for each citation, 0.008 at most."""
    return feedback.where(cited).groupBy(*keys).agg(F.least(F.lit(0.008), 0.002 * F.count(F.lit(1))).alias("boost"))


def identity_rerank(candidates: DataFrame) -> DataFrame:
    """The default reranker: the fused order stays."""
    return candidates.withColumn("rerank", F.lit(0.0))


def overlap_rerank(candidates: DataFrame, query_text: str = "query_text", text: str = "text", chars: int = 1500) -> DataFrame:
    """A lexical reranker: share of the query's terms in the first ``chars`` characters."""
    q, d = F.array_distinct(tokens(F.col(query_text))), tokens(F.substring(text, 1, chars))
    return candidates.withColumn("rerank", F.coalesce(F.try_divide(F.size(F.array_intersect(q, d)), F.size(q)), F.lit(0.0)))


#: Rerankers by name. Each adds ``rerank`` to candidates; a cross-encoder is added as a function over ``mapInPandas``.
RERANKERS = {"identity": identity_rerank, "overlap": overlap_rerank}


def asks_case_law(query: Column) -> Column:
    """Whether a query asks for case law."""
    # Words for decisions and precedents.
    return F.coalesce(query.rlike(r"(?i)putusan|yurisprudensi|preseden|preceden|jurisprudensi|fatwa|penetapan|doktrin\s+putusan"), F.lit(False))


def reranked(candidates: DataFrame, reranker: str, top: int = 48) -> DataFrame:
    """``candidates(query_id, id, rank, ...)`` with ``pos`` from 1: the first ``top`` of each query anew by the named reranker, ties and the rest in their order."""
    head = F.col("rank") < top
    order = [~head, F.when(head, F.round("rerank", 9)).desc(), F.col("rank")]
    return RERANKERS[reranker](candidates).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def context(found: DataFrame, docs: DataFrame, n: int = 5, separator: str = "\n") -> DataFrame:
    """``(query_id, context)``: texts of the best ``n`` of each query, joined in order. ``found(query_id, id, rank)``, ``docs(id, text)``; a null text is left out."""
    best = found.where(F.col("rank") < n).join(docs.select("id", "text"), "id").where("text is not null")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda r: r["text"])
    return best.groupBy("query_id").agg(F.array_join(texts, separator).alias("context"))


def feedback_rows(results: DataFrame, cited: DataFrame) -> DataFrame:
    """A row for each retrieved article, with ``cited``: whether the answer names it. ``results(query_id, law, article)``, ``cited(query_id, article)``."""
    named = cited.select("query_id", "article").distinct().withColumn("cited", F.lit(True))
    return results.select("query_id", "law", "article").join(named, ["query_id", "article"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


#: What a model asks to be written before queries and passages.
PREFIXES = {"query": "query: ", "passage": "passage: "}


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A stand-in for a model: counts of words by a hash of the word, at length 1; no words give zeros."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that a lambda reads often is worked out once
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[^ \t\n\r]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(width)))
    counts = once(places, lambda found: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.size(F.filter(found, lambda p: p == d)).cast("double")))
    norm = lambda c: F.greatest(F.sqrt(F.aggregate(c, F.lit(0.0), lambda total, n: total + n * n)), F.lit(1e-12))
    return once(counts, lambda c: once(norm(c), lambda length: F.transform(c, lambda n: n / length)))


#: Embedders by name: a column of texts to a column of vectors; a model is added as a Pandas function of this form.
EMBEDDERS = {"hash": hash_embedding}


def embed(rows: DataFrame, kind: str, embedder: str = "hash", id_col: str = "id", text: str = "text") -> DataFrame:
    """``(id, vector)`` of texts as ``query`` or ``passage``, by the named embedder; a null text is empty."""
    whole = F.concat(F.lit(PREFIXES[kind]), F.coalesce(F.col(text), F.lit("")))
    return rows.select(id_col, EMBEDDERS[embedder](whole).alias("vector"))


def hybrid(lexical: DataFrame, near: DataFrame, meta: DataFrame, boosts: DataFrame, case_law_queries: DataFrame, n: int = 12, floor: float = 0.72, admitted: int = 10, pin_at: float = 0.08, rerank=identity_rerank, rerank_top: int = 48, optional: dict[str, str] | None = None) -> DataFrame:
    """The assembled result of each query: ``(query_id, pos, id, law, article, score)`` and the ``optional`` fields.

    Fused candidates in order of score; the best ``rerank_top`` are ordered anew by
    ``rerank``; case law goes last unless the query asks for it; ids whose mention
    boost reaches ``pin_at`` come first, fused or not. A dense hit below ``floor`` is
    left out; a purely lexical one needs a pin or a lexical rank below ``admitted``
    and reports ``floor``. Of each (law, article) the first stays; the first ``n``.

    ``meta``: id, law, article, case_law (boolean) and what ``rerank`` needs; with
    ``optional``, names and types of fields, also ``extra``, a JSON text that may hold them: what is absent,
    malformed or of another type is null.
    ``boosts``: query_id, id, boost, mention (boolean). ``case_law_queries``: query_id.
    """
    fused = fuse([lexical, near], boosts)
    pins = boosts.where("mention").groupBy("query_id", "id").agg(F.sum("boost").alias("mention")).where(F.col("mention") >= pin_at).select("query_id", "id", F.lit(True).alias("pinned"))
    every = fused.join(pins, ["query_id", "id"], "full").withColumns({"score": F.coalesce("score", F.lit(0.0)), "pinned": F.coalesce("pinned", F.lit(False))})
    every = every.join(meta, "id").join(case_law_queries.select("query_id", F.lit(True).alias("_asks")), "query_id", "left")
    by_query = lambda *c: Window.partitionBy("query_id").orderBy(*c)
    every = every.withColumn("_first", F.row_number().over(by_query(F.round("score", 9).desc(), "id")))
    every = rerank(every).withColumn("_again", F.row_number().over(by_query(F.col("_first") > rerank_top, F.when(F.col("_first") <= rerank_top, F.col("rerank")).desc(), "_first")))
    last = F.col("case_law") & F.col("_asks").isNull()
    every = every.join(near.select("query_id", "id", F.col("score").alias("cos")), ["query_id", "id"], "left").join(lexical.select("query_id", "id", F.col("rank").alias("lex_rank")), ["query_id", "id"], "left")
    kept = every.where(F.when(F.col("cos").isNotNull(), (F.col("cos") >= floor) | F.col("pinned")).otherwise(F.col("pinned") | (F.col("lex_rank") < admitted)))
    order = [~F.col("pinned"), last, F.col("_again")]
    kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", "law", "article").orderBy(*order))).where("_nth = 1")
    kept = kept.withColumn("pos", F.row_number().over(by_query(*order))).where(F.col("pos") <= n)
    more = [optional_field(F.col("extra"), field, kind).alias(field) for field, kind in (optional or {}).items()]
    return kept.select("query_id", "pos", "id", "law", "article", F.round(F.greatest(F.coalesce("cos", F.lit(floor)), F.lit(floor)), 3).alias("score"), *more)
