"""Tables of a database: one ranged, pushed-down scan in place of a query a row.

Any database with a JDBC driver on Spark's class path. Derby is among Spark's own
jars; in memory it lives in one process, so it serves local sessions and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def write(rows: DataFrame, url: str, name: str, types: str = "", driver: str = DERBY, batch: int = 5000) -> None:
    """``rows`` as table ``name``, replacing it; ``types`` are the database's column types where the defaults don't serve, as large objects can't be compared."""
    rows.write.mode("overwrite").options(**({"createTableColumnTypes": types} if types else {})).option("driver", driver).option("batchsize", batch).option("isolationLevel", "NONE").jdbc(url, name)


def scan(spark: SparkSession, url: str, name: str, by: str | None = None, parts: int = 8, driver: str = DERBY) -> DataFrame:
    """Table ``name``, in ``parts`` ranges of the number column ``by``, whose ends are asked of the database first.

    Filters, and with them aggregates and limits where there is one part, are done by the database.
    """
    reader = spark.read.option("driver", driver).option("pushDownAggregate", "true").option("pushDownLimit", "true")
    if by is None:
        return reader.jdbc(url, name)
    ends = spark.read.option("driver", driver).jdbc(url, f"(select min(\"{by}\") as lo, max(\"{by}\") as hi from {name}) ends").first()
    if ends[0] is None:
        return reader.jdbc(url, name)
    return reader.jdbc(url, name, column=by, lowerBound=int(ends[0]), upperBound=int(ends[1]) + 1, numPartitions=parts)
