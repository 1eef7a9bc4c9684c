"""Event-at-a-time operators: hash chains, rate limits, job states, waits.

Each runs per key. A chain or limiter is sequential inside its key, so keys are
the unit of parallel work; chain verification has no such limit.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def utc_text(ts: Column) -> Column:
    """ISO text of a timestamp in UTC; microseconds only where there are any."""
    at = ts.cast("timestamp")
    micros = F.unix_micros(at) % 1_000_000
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def entry_hash(prev: Column, *fields: Column) -> Column:
    """SHA-256 of the previous hash and the fields, joined by bars; nulls are empty."""
    return F.sha2(F.concat_ws("|", prev, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def chain_append(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """``rows`` with ``prev_hash`` and ``entry_hash``: a fold in order, one chain a key.

    Each key streams through one Python worker in batches of sorted rows; only the
    last hash is held.
    """
    schema = f"{key} string, {order} long, {payload} string, prev_hash string, entry_hash string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple[object, str] = (None, GENESIS)
        for part in parts:
            prevs, hashes = [], []
            for k, p in zip(part[key], part[payload], strict=True):
                prev = last[1] if last[0] == k else GENESIS
                digest = hashlib.sha256(f"{prev}|{p}".encode()).hexdigest()
                prevs.append(prev)
                hashes.append(digest)
                last = (k, digest)
            yield part.assign(prev_hash=prevs, entry_hash=hashes)

    ordered = rows.select(F.col(key).cast("string"), F.col(order).cast("long"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias(payload))
    return ordered.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def chain_verify(chain: DataFrame, key: str, order: str, payload: list[str]) -> DataFrame:
    """Per key: rows checked before the first broken one, its ``order`` value and the count of chained rows.

    A row is broken if its digest is not that of its fields, or its ``prev_hash`` is
    not the hash of the row before. Rows without a hash are skipped. Digests are
    computed row by row in parallel; only order and hashes pass the window.
    """
    digest = entry_hash(F.col("prev_hash"), *[F.col(p) for p in payload])
    hashed = chain.where("entry_hash is not null").select(key, order, "prev_hash", "entry_hash", (digest == F.col("entry_hash")).alias("own"))
    w = Window.partitionBy(key).orderBy(order)
    linked = hashed.withColumn("_bad", ~(F.col("own") & (F.col("prev_hash") == F.lag("entry_hash", 1, GENESIS).over(w)))).withColumn("_nth", F.row_number().over(w))
    first = F.min(F.when(F.col("_bad"), F.struct("_nth", order)))
    out = linked.groupBy(key).agg(first.alias("b"), F.count(F.lit(1)).alias("n_chained"))
    return out.select(key, F.coalesce(F.col("b._nth") - 1, F.col("n_chained")).alias("n_valid"), F.col(f"b.{order}").alias("first_broken"), "n_chained")


def demand(hits: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """``demand``: hits of the key in the last ``seconds``, the row's own included, whether admitted or not."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return hits.withColumn("demand", F.count(F.lit(1)).over(w))


class Limiter:
    """Admissions of one key in a sliding window; rejected hits leave no trace.

    ``admitted`` are the sorted times that may still count. A hit exactly ``window``
    old counts; hits of equal time come in the order given.
    """

    def __init__(self, limit: int, window: float, admitted: list[float] | None = None):
        self.limit, self.window, self.admitted = limit, window, sorted(admitted or [])

    def hit(self, now: float) -> int | None:
        """None if admitted, else seconds to wait."""
        counting = self.admitted[bisect_left(self.admitted, now - self.window) :]
        if len(counting) < self.limit:
            self.admitted = [*counting, now]
            return None
        return int(counting[0] + self.window - now) + 1


def rate_limit(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``hits(id, ip, method, path, ts double)`` with ``rule``, ``admitted`` and ``retry_after``.

    ``rules(rule, method, prefix, max_hits, window_s)``: the first that fits by
    ``rule`` holds; hits that none fits are admitted. Hits of equal ``ts`` come by ``id``. The limiter's state per (ip,
    rule) is at most ``max_hits`` times; sorted hits stream through it.
    """
    from .keyed import top_per_key

    fits = (F.col("method") == F.col("_method")) & F.startswith("path", "prefix")
    ruled = top_per_key(hits.join(rules.withColumnRenamed("method", "_method"), fits, "left"), ["id"], [F.col("rule").asc_nulls_last()])
    schema = "id long, ip string, rule int, admitted boolean, retry_after int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                if (r.ip, r.rule) != key:
                    key, limiter = (r.ip, r.rule), Limiter(int(r.max_hits), float(r.window_s))
                out.append(limiter.hit(r.ts))
            yield pd.DataFrame({"id": part["id"], "ip": part["ip"], "rule": part["rule"], "admitted": [w is None for w in out], "retry_after": pd.array(out, "Int32")})

    limited = ruled.where("rule is not null").select("id", "ip", F.col("rule").cast("int"), "max_hits", "window_s", "ts")
    limited = limited.repartition("ip", "rule").sortWithinPartitions("ip", "rule", "ts", "id").mapInPandas(run, schema)
    free = ruled.where("rule is null").select("id", "ip", F.lit(None).cast("int").alias("rule"), F.lit(True).alias("admitted"), F.lit(None).cast("int").alias("retry_after"))
    return limited.unionByName(free)


def lifecycle(events: DataFrame, key: str, seq: str, status: str, stage: str) -> DataFrame:
    """Per job: latest status, its stages in order of completion (each once) and whether it ended."""
    stages = events.where(F.col(stage).isNotNull()).groupBy(key, stage).agg(F.min(seq).alias("_at")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", stage))), lambda x: x[stage]), ",").alias("stages"))
    last = events.groupBy(key).agg(F.max_by(status, seq).alias("status"), F.max(seq).alias("last_seq"), F.min(seq).alias("first_seq"))
    return last.join(stages, key, "left").withColumn("ended", F.col("status").isin("done", "failed")).withColumn("stages", F.coalesce("stages", F.lit("")))


def waits(hits: DataFrame, key: str, ts: str, order: str, per_second: float) -> DataFrame:
    """``wait_us``: how long each hit must wait for ``per_second`` hits of its key."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(Window.partitionBy(key).orderBy(ts, order))
    return hits.withColumn("wait_us", F.greatest(F.lit(0), F.coalesce(F.lit(int(1_000_000 / per_second)) - gap, F.lit(0))).cast("long"))


def rising(ts: Column, key: str, order: str) -> Column:
    """Microseconds of ``ts`` made strictly increasing in a key: at least one more than the entry before.

    The running rule ``max(now, before + 1)`` in closed form: the position plus the
    greatest of time less position so far.
    """
    w = Window.partitionBy(key).orderBy(order)
    nth = F.row_number().over(w)
    return nth + F.max(F.unix_micros(ts.cast("timestamp")) - nth).over(w.rowsBetween(Window.unboundedPreceding, 0))


def decisions(rows: DataFrame, request: str, order: str, action: str) -> DataFrame:
    """Decisions (``execute`` or ``reject``) with ``status``: 200 for the first of a request, 409 for all later ones."""
    nth = F.row_number().over(Window.partitionBy(request).orderBy(order))
    return rows.where(F.col(action).isin("execute", "reject")).withColumn("status", F.when(nth == 1, 200).otherwise(409))


def running_kinds(jobs: DataFrame, kind: str, status: str) -> DataFrame:
    """Per kind of job, whether one is queued or running."""
    return jobs.groupBy(kind).agg(F.coalesce(F.bool_or(F.col(status).isin("queued", "running")), F.lit(False)).alias("has_running"))
