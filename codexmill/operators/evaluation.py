"""Retrieval metrics and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_zeros
from .containment import contained


def gold_keys(gold: DataFrame) -> DataFrame:
    """``(question_id, number, year, article)``: all three columns if all are filled, else read from the question.

    A question names number, year and then the article's digits, in this order. Rows
    without a key or a question are left out.
    """
    # How a question names law and article.
    named = r"(?is)Nomor\s+(\d+)\s+Tahun\s+(\d{4}).*?Pasal\s+(\d+)"
    given = [F.col(c).cast("string") for c in ("law_number", "law_year", "pasal")]
    full = F.lit(True)
    for c in given:
        full &= F.coalesce(c, F.lit("")) != ""
    read = [F.nullif(F.regexp_extract("question", named, i), F.lit("")) for i in (1, 2, 3)]
    number, year, article = (F.when(full, c).otherwise(r) for c, r in zip(given, read, strict=True))
    return gold.where("question <> ''").select("question_id", no_zeros(number).alias("number"), year.alias("year"), no_zeros(article).alias("article")).where("number is not null")


def first_hits(results: DataFrame, keys: DataFrame) -> DataFrame:
    """Per question its least rank whose law and article are the gold ones, else null."""
    number = no_zeros(F.regexp_extract("law_name", r"(?i)Nomor\s+(\d+)", 1))
    year = F.regexp_extract("law_name", r"(?i)Tahun\s+(\d{4})", 1)
    article = no_zeros(F.element_at(F.split(F.trim("article_number"), r"\s+"), -1))
    got = results.select("question_id", "rank", number.alias("number"), year.alias("year"), article.alias("article"))
    hit = keys.join(got, ["question_id", "number", "year", "article"]).groupBy("question_id").agg(F.min("rank").alias("hit"))
    return keys.join(hit, "question_id", "left")


def metrics(hits: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """One row: hit rate and MRR at ``k``, hit rate among covered laws, coverage."""
    known = registry.select(no_zeros(F.col("number")).alias("number"), "year", F.lit(1).alias("covered")).distinct()
    h = hits.join(known, ["number", "year"], "left").withColumn("ok", F.when(F.col("hit") <= k, 1.0).otherwise(0.0))
    return h.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("ok"), 4).alias("hit_rate"),
        F.round(F.avg(F.coalesce(F.when(F.col("hit") <= k, 1.0 / F.col("hit")), F.lit(0.0))), 4).alias("mrr"),
        F.round(F.avg(F.when(F.col("covered") == 1, F.col("ok"))), 4).alias("covered_hit_rate"),
        F.round(F.avg(F.coalesce(F.col("covered"), F.lit(0))), 4).alias("coverage"),
    )


def gap_rows(answers: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``answers(topic, question, answer, score, at)`` as rows of the self-evaluation log: a score under the threshold is a gap to be researched again."""
    passed = F.col("score") >= threshold
    text = F.format_string(f"Skor %.2f < {threshold} untuk topik %s", "score", "topic")
    return answers.select(
        "topic",
        "question",
        F.substring("answer", 1, 4000).alias("generated_answer"),
        F.col("score").alias("answer_quality"),
        F.when(~passed, text).alias("gap_description"),
        F.when(~passed, "re-research terjadwal").alias("remediation_action"),
        passed.alias("resolved"),
        F.when(passed, F.col("at")).alias("resolved_at"),
    )


def gold_lookup(chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """``(gold_id, id)``: the first chunk (by id) of each gold row's article whose law's name holds its keyword.

    ``chunks(id, law_name, article_number)``, ``gold(gold_id, law_keyword,
    article_number)``. Of the chunks of a law's article only the first can be found, so a row for each
    is kept, and keywords are looked up among the names of laws.
    """
    first = chunks.groupBy("law_name", "article_number").agg(F.min("id").alias("id"))
    names, words = first.select("law_name").distinct(), gold.select("law_keyword").distinct()
    meant = contained(words, "law_keyword", names, "law_name", "law_name")
    return gold.join(meant, "law_keyword").join(first, ["law_name", "article_number"]).groupBy("gold_id").agg(F.min("id").alias("id"))


def node_scores(nodes: DataFrame, expected: DataFrame, registry: DataFrame) -> DataFrame:
    """``nodes(node, canonical)`` with ``score``: a canonical node 1.0 with a law of its identities, 0.3 with any document, else 0; another 0.8 with any document, else 0.

    ``expected(node, number, year)`` are the identities, ``registry(node, number,
    year)`` the documents that match the node.
    """
    exact = registry.join(expected.distinct(), ["node", "number", "year"], "left_semi").select("node", F.lit(True).alias("exact")).distinct()
    some = registry.select("node", F.lit(True).alias("some")).distinct()
    j = nodes.join(exact, "node", "left").join(some, "node", "left")
    canonical = F.when(F.col("exact"), 1.0).when(F.col("some"), 0.3).otherwise(0.0)
    return j.select("node", F.when(F.col("canonical"), canonical).otherwise(F.when(F.col("some"), 0.8).otherwise(0.0)).alias("score"))


def element_scores(rows: DataFrame, key: str = "id") -> DataFrame:
    """Expected against extracted elements: ``(key, pelaku, recall, prec, penjara, denda, status)``.

    ``rows(key, want_pelaku, want_sikap, want_max, want_denda, pelaku, sikap, got_max,
    got_denda)``: shares of the mens-rea phrases, equal bounds, a fine at least as
    expected; ``status`` lists what failed, or says that nothing was extracted.
    """
    none = F.array().cast("array<string>")
    common, got = F.size(F.array_intersect("want_sikap", F.coalesce("sikap", none))), F.coalesce(F.size("sikap"), F.lit(0))
    s = rows.select(
        key,
        F.coalesce(F.contains("pelaku", F.col("want_pelaku")), F.lit(False)).alias("pelaku"),
        F.when(F.size("want_sikap") == 0, 1.0).otherwise(common / F.size("want_sikap")).alias("recall"),
        F.when(F.col("sikap").isNull(), 0.0).otherwise(common / F.greatest(got, F.lit(1))).alias("prec"),
        F.coalesce(F.col("want_max") == F.col("got_max"), F.lit(False)).alias("penjara"),
        F.coalesce(F.col("got_denda") >= F.col("want_denda"), F.lit(False)).alias("denda"),
        F.col("sikap").isNull().alias("_none"),
    )
    failing = F.array_compact(F.array(F.when(~F.col("pelaku"), "pelaku"), F.when(F.col("recall") < 1, "sikap"), F.when(~F.col("penjara"), "penjara"), F.when(~F.col("denda"), "denda")))
    return s.withColumn("status", F.when(F.col("_none"), "no_elements").when(F.size(failing) == 0, "ok").otherwise(F.array_join(failing, ","))).drop("_none")


def abstention(scores: Column, cited: Column, verified: Column, floor: float = 0.55) -> Column:
    """Why an answer abstains, else null: no article; the best score below ``floor``; two citations or more and none verified."""
    best = F.coalesce(F.array_max(scores), F.lit(0.0))
    return F.when(F.coalesce(F.size(scores), F.lit(0)) == 0, "no_evidence").when(best < floor, "weak_evidence").when((cited >= 2) & (verified == 0), "ungrounded_citations")


def quiz_score(answer: Column) -> Column:
    """The first decimal number of a free text, between 0 and 1; 0 if there is none."""
    found = F.nullif(F.regexp_extract(answer, r"[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(found, F.lit(0.0))))


def self_evaluation(answers: DataFrame, node: str = "node", answer: str = "answer", threshold: float = 0.7) -> DataFrame:
    """``(node, n, mean, gaps, status)``: the mean of a node's scores decides, and low answers are gaps."""
    g = answers.withColumn("_score", quiz_score(F.col(answer))).groupBy(node).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_score"), 3).alias("mean"), F.count_if(F.col("_score") < threshold).alias("gaps"))
    return g.withColumn("status", F.when(F.col("mean") >= threshold, "completed").otherwise("gap_detected"))
