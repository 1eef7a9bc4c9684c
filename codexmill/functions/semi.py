"""Semi-structured values: JSON of unknown shape as VARIANT, typed by the schema that the rows themselves show."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(c: Column) -> Column:
    """JSON text as VARIANT; null if it is absent or malformed."""
    return F.try_parse_json(c)


def discovered(rows: DataFrame, column: str) -> str:
    """The schema that all well-formed rows of a JSON column share, as a type; ``void`` for no rows."""
    found = rows.select(F.schema_of_variant_agg(variant(F.col(column)))).first()[0]
    return re.sub(r"\bOBJECT<", "STRUCT<", found or "VOID")


def typed(rows: DataFrame, column: str, name: str, schema: str | None = None) -> DataFrame:
    """``rows`` with ``name``: the JSON column by its discovered (or given) schema; malformed rows are kept as null."""
    kind = schema or discovered(rows, column)
    return rows.withColumn(name, F.try_variant_get(variant(F.col(column)), "$", kind) if kind != "VOID" else F.lit(None))


def optional(c: Column, field: str, kind: str) -> Column:
    """A field of a JSON text, null if the text, the field or its type is not there."""
    return F.try_variant_get(variant(c), f"$.{field}", kind)
