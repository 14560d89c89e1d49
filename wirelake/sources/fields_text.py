"""Dissected text, one packet a line: columns parted by 0x1F, a field's occurrences by 0x1E."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.expr import FieldRef
from wirelake.sources.process import COLUMN, OCCURRENCE


def split_line(line: Column, refs: Sequence[FieldRef]) -> Column:
    """Array of each field's raw occurrences; a line with another number of columns raises. An empty column is an absent field."""
    parts = F.split(line, COLUMN)
    bad = F.raise_error(F.concat(F.lit(f"a line has not {len(refs)} columns but "), F.size(parts).cast("string"), F.lit(": "), F.substring(line, 1, 200))).cast("array<string>")
    checked = F.when(F.size(parts) == len(refs), parts).otherwise(bad)
    return F.transform(checked, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, OCCURRENCE)))


def raw_fields(lines: DataFrame, refs: Sequence[FieldRef], column: str = "value") -> DataFrame:
    """One array<string> column for each field, named by the field, from lines of text."""
    if not refs:
        return lines.select()
    split = lines.select(split_line(F.col(f"`{column}`"), refs).alias("f"))
    return split.select(*[F.get("f", F.lit(i)).alias(r.name) for i, r in enumerate(refs)])


def read_fields_text(spark: SparkSession, path: str | list[str], refs: Sequence[FieldRef]) -> DataFrame:
    """Files of such lines. Lines end at \\n alone: values may hold \\r."""
    return raw_fields(spark.read.option("lineSep", "\n").text(path), refs)
