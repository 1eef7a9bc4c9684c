"""Tables of an embedded database that sessions of many processes share: one SQLite database a range of a key, kept as a row.

A database in memory belongs to one process, and a file of it to one machine. Here a task
fills the database of its range, its bytes are a row of a table in the shared folder, and
the task that scans the range opens them where it runs. A filter is the database's work.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Rows of a database, and rows handed over at once; both only bound memory.
ROWS, AT_ONCE = 100_000, 10_000


def write(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Table ``name`` of ``rows``, in ranges of ``key`` of about ``ROWS`` rows: a table of databases."""
    n, columns = max(1, -(-rows.count() // ROWS)), rows.columns
    quoted = ", ".join(f'"{c}"' for c in columns)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sqlite3.connect(":memory:")
        base.execute(f'CREATE TABLE "{name}" ({quoted})')
        for batch in batches:
            base.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns))})', zip(*[c.to_pylist() for c in batch.columns], strict=True))
        base.commit()
        yield pa.record_batch([pa.array([base.serialize()], pa.binary())], ["content"])
        base.close()

    return written(rows.repartitionByRange(n, key).mapInArrow(fill, "content binary"), "databases")


def scan(databases: DataFrame, name: str, schema: str, where: str = "1") -> DataFrame:
    """Rows of table ``name`` that pass ``where``, a condition in the database's SQL, as ``schema`` has them."""
    spark = databases.sparkSession
    kinds = spark.createDataFrame([], schema).toArrow().schema
    sql = f"SELECT {', '.join(chr(34) + c + chr(34) for c in kinds.names)} FROM \"{name}\" WHERE {where}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                base = sqlite3.connect(":memory:")
                base.deserialize(content.as_py())
                found = base.execute(sql)
                while rows := found.fetchmany(AT_ONCE):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                base.close()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return databases.repartition(n, F.xxhash64("content")).mapInArrow(read, schema)
