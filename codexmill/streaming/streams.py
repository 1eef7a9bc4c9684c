"""Structured Streaming forms of the stateful operators.

Each starts one query with an available-now trigger over a file source, so that a
run ends when the input does; the same transformations serve an unbounded source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import Limiter


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files that ``path`` names; a pattern, as a stream takes no single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def run(stream: DataFrame, out: str, mode: str, sink: Callable | None = None, name: str | None = None) -> DataFrame:
    """Runs a stream to the end of its input and reads what it wrote."""
    writer = stream.writeStream.queryName(name) if name else stream.writeStream
    writer = writer.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint")
    if sink:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", f"{out}/data").start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/data")


def window_counts(events: DataFrame, ts: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts and sums of tumbling windows; state older than the watermark goes."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def replace_with(out: str) -> Callable:
    """A sink for complete output: each batch replaces the last."""
    return lambda df, _: df.write.mode("overwrite").parquet(f"{out}/data")


def dedup(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def import_new(folder: str, key: str) -> Callable:
    """A sink that appends only rows whose key the table lacks; a repeated batch adds nothing."""

    def sink(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates([key])
        try:
            known = df.sparkSession.read.parquet(folder).select(key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").parquet(folder)

    return sink


def rate_limit(hits: DataFrame, key: str, limit: int, window_s: float) -> DataFrame:
    """``(key, id, admitted)`` of a stream ``hits(key, id, ts double)``; the state is the admitted times of the window.

    Hits of a batch are taken in order of time and id; one that comes in a later
    batch than newer hits is judged against those, so files should come in time order.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        limiter = Limiter(limit, window_s, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(["ts", "id"])
        admitted = [limiter.hit(t) is None for t in rows["ts"]]
        state.update((list(limiter.admitted),))
        yield pd.DataFrame({key: k[0], "id": rows["id"].to_numpy(), "admitted": admitted})

    return hits.groupBy(key).applyInPandasWithState(step, f"{key} string, id long, admitted boolean", "times array<double>", "append", "NoTimeout")
