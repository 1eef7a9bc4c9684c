"""Streaming queries over the event files (an extension), with SQL for their final state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import streams

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/codexmill/stream-{uuid.uuid4().hex}"


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.source(spark, f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _place(spark)
    done = streams.run(streams.window_counts(events, "ts", "1 day", "6 hours", "event_type"), out, "complete", streams.replace_with(out))
    return done.select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streams.source(spark, f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.run(streams.dedup(events, "ts", "40 days", ["user_id", "event_type"]).select("user_id", "event_type"), _place(spark), "append")


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first admitted hit of each user, by a limiter whose state is kept between batches."""
    events = streams.source(spark, f"{sf_dir}/events.parque[t]")
    hits = events.select(F.col("user_id").cast("string").alias("user"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    done = streams.run(streams.rate_limit(hits, "user", 5, 86400.0), _place(spark), "append")
    return done.where("admitted").groupBy(F.col("user").cast("long").alias("user_id")).agg(F.min("id").alias("first_event"))
