"""Headings and the path of levels above each, as a table function over lines.

``sections(TABLE(..) PARTITION BY key ORDER BY line)`` takes one line after another and holds
only the open section and its path, so a text of any length streams through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Sections:
    """Rows of ``(key, line_no, level, heading, path, chars)``: a section for each heading, with the characters of its body.

    The table has the columns key, line number, level (null for a body line) and text,
    in this order. A heading ends the sections of its own and all lower levels.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        fields = rows.dataType.fields
        if len(fields) != 4 or not isinstance(fields[2].dataType, IntegerType) or not isinstance(fields[3].dataType, StringType):
            raise ValueError("sections takes a table of key, line number, level (int) and line (string)")
        out = StructType().add(fields[0].name, fields[0].dataType).add(fields[1].name, fields[1].dataType)
        return AnalyzeResult(schema=out.add("level", IntegerType()).add("heading", StringType()).add("path", StringType()).add("chars", IntegerType()))

    def __init__(self):
        self.open: dict[int, str] = {}
        self.section: list | None = None

    def eval(self, row):
        key, number, level, line = row
        if level is None:
            if self.section:
                self.section[-1] += len(line or "")
            return
        if self.section:
            yield tuple(self.section)
        self.open = {at: name for at, name in self.open.items() if at < level} | {level: line}
        self.section = [key, number, level, line, " > ".join(self.open[at] for at in sorted(self.open)), 0]

    def terminate(self):
        if self.section:
            yield tuple(self.section)


def sections(spark: SparkSession, lines: DataFrame, key: str, number: str) -> DataFrame:
    """Sections of ``lines(key, number, level, line)``, through SQL."""
    spark.udtf.register("codexmill_sections", F.udtf(Sections))
    lines.createOrReplaceTempView("codexmill_lines")
    return spark.sql(f"SELECT * FROM codexmill_sections(TABLE(SELECT `{key}`, `{number}`, level, line FROM codexmill_lines) PARTITION BY `{key}` ORDER BY `{number}`)")
