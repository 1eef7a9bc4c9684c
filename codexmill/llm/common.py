"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import CLEANUP, delete, new_path, removed, setting, written
from ..session import shared_dir

__all__ = ["CLEANUP", "ascii_lower", "delete", "in_worker", "new_path", "removed", "setting", "shared_dir", "table", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: What the tasks of one operator keep in a worker process.
_kept: dict[object, object] = {}


def in_worker(kind: object, make: Callable[[], object]) -> object:
    """What tasks of one kind keep in a worker process for the next one, such as a memo or a trie.

    A worker serves one operator after the other; only what the last kind keeps stays.
    """
    if kind not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[kind] = make()
    return _kept[kind]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
