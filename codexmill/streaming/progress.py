"""How far a job is: figures observed in passing, progress of streams, time left."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..scratch import written


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left at the pace so far; null unless 0 < done < total."""
    return F.when((done > 0) & (done < total), F.round(F.try_divide(elapsed, done) * (total - done)).cast("long"))


def observed(rows: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with aggregates that are worked out as the rows pass, in the one action that reads them."""
    seen = Observation()
    return rows.observe(seen, *[c.alias(n) for n, c in figures.items()]), seen


def with_figures(rows: DataFrame, derived, **figures: Column) -> DataFrame:
    """``derived(rows)``, written in one pass, with the figures observed on the way as columns of each row."""
    passing, seen = observed(rows, **figures)
    out = written(derived(passing), "observed")
    return out.select("*", *[F.lit(v).alias(n) for n, v in seen.get.items()])


class ProgressLog(StreamingQueryListener):
    """Rows ``(batch, rows, state_rows, total_rows)`` of a session's stream named ``name``."""

    def __init__(self, name: str):
        self.name, self.rows, self.run, self.ended = name, [], None, threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) == self.run:
            before = self.rows[-1][-1] if self.rows else 0
            self.rows.append((p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators), before + p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.ended.set()

    def table(self, spark, wait_s: float = 30) -> DataFrame:
        """The rows so far; listeners hear of a query's end a little later than the query itself."""
        self.ended.wait(wait_s)
        return spark.createDataFrame(self.rows, "batch long, rows long, state_rows long, total_rows long")
