"""A sliding-window limiter over a stream, in order of event time, with state that expires.

Hits wait in a list state until the watermark has passed them, so hits that come
late, but within the allowed lateness, are judged where they belong. An event-time timer of the key judges what waits
and clears the key's state once no admitted hit can count any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.audit import Limiter

OUT = "id long, key string, admitted boolean, retry_after int"
#: The state store that lists and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ExpiringLimiter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, id long, most int, window_us long")
        self.admitted = handle.getListState("admitted", "us long, window_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(zip(part["us"].tolist(), part["id"].tolist(), part["most"].tolist(), part["window_us"].tolist(), strict=True))
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new) if first is None else min(first, min(r[0] for r in new))
        if first is not None:
            self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        held = [tuple(r) for r in self.admitted.get()] if self.admitted.exists() else []
        admitted, window, out = [us for us, _ in held], held[0][1] if held else 0, []
        for us, id_, most, window_us in ready:
            limiter, window = Limiter(most, window_us, admitted), window_us
            wait = limiter.hit(us)
            admitted = limiter.admitted
            out.append((id_, key[0], wait is None, None if wait is None else (wait - 1) // 1_000_000 + 1))
        # A hit to come is after the watermark; an admitted one counts until its window has passed.
        admitted = [us for us in admitted if us + window > passed]
        if later:
            self.waiting.put(later)
            self.wake(min(r[0] for r in later))
        else:
            self.waiting.clear()
        if admitted:
            self.admitted.put([(us, window) for us in admitted])
            if not later:
                self.wake(max(admitted) + window)
        else:
            self.admitted.clear()
        if out:
            yield pd.DataFrame(out, columns=["id", "key", "admitted", "retry_after"]).astype({"retry_after": "Int32"})

    def wake(self, us: int) -> None:
        self.handle.registerTimer(ceil(us / 1000))

    def close(self) -> None:
        pass


def limited(hits: DataFrame, late: str) -> DataFrame:
    """``(id, key, admitted, retry_after)`` of a stream ``hits(id, key, ts, most, window_s)``; ``late`` is how late a hit may come."""
    rows = hits.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), F.col("id").cast("long").alias("id"), F.col("most").cast("int").alias("most"), (F.col("window_s").cast("long") * 1_000_000).alias("window_us"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=ExpiringLimiter(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
