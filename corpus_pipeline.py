"""The training-data pipeline: language, lines, near copies, benchmark, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; what it keeps
is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from codexmill.llm.common import shared_dir, table

#: The trie and the automaton have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None

#: Documents whose language is less sure than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those of no clear language; an unknown ``lang`` takes the prediction."""
    model = language_id.train(docs)
    judged = language_id.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least 10 documents hold; every document stays, with its new length."""
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: five-word shingles, 0.8 or more."""
    return jaccard_join.deduplicate(docs, k=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents contaminated by the benchmark."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: number of tokens and digests."""
    return byte_bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontaminate", benchmark),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/codexmill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
