"""Captures that grow: dissected text that is tailed as a stream, and conversations kept up to date over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.expr import FieldRef
from wirelake.sources.capture import with_values
from wirelake.sources.fields_text import raw_fields


def tail_fields_text(spark: SparkSession, folder: str, refs: Sequence[FieldRef], files_per_trigger: int | None = None) -> DataFrame:
    """Typed columns, named by the field, of files of dissected text as they appear in ``folder``."""
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_values(raw_fields(reader.load(folder), refs), refs)


def windowed_conversations(packets: DataFrame, by: list[str], key: str, time: str, size: str, window: str, lateness: str) -> DataFrame:
    """Counts of each conversation by time window; packets later than ``lateness`` are dropped, state older than that is given up."""
    t = F.col(f"`{time}`").cast("timestamp")
    timed = packets.withColumn("__t", t).withWatermark("__t", lateness)
    grouped = timed.groupBy(F.window("__t", window).alias("w"), *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in by])
    out = grouped.agg(F.min(F.col(f"`{key}`")).alias("first_frame"), F.max(F.col(f"`{key}`")).alias("last_frame"), F.count(F.lit(1)).alias("pkt_count"), F.sum(F.col(f"`{size}`")).alias("byte_count"))
    return out.select(F.col("w.start").alias("window_start"), *[c.replace(".", "_") for c in by], "first_frame", "last_frame", "pkt_count", "byte_count")
