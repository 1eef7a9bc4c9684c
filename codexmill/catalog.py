"""Tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Catalyst prunes its columns and pushes its filters."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)
