"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir

#: Folder of each written table that has not been removed.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of tables between steps: bytes a writer gathers before it writes, and rows that go to Python at once. Both only bound memory.
ROW_GROUP, ARROW_ROWS = str(16 << 20), "1000"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codexmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage: a lost executor costs the readers nothing but a reread,
    and a result that several later steps use is computed once. The shuffle files
    of the write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("parquet.block.size", ROW_GROUP)
    with setting(spark, CLEANUP, "true"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def removed(*tables: DataFrame) -> None:
    """Deletes what ``written`` made, once the last table that reads it is written too."""
    for df in tables:
        delete(df.sparkSession, _paths.pop(df))
