"""Findings on packets and streams, and which of them have lost their target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPES = ("packet", "stream")
SCHEMA = "annotation_id long, scope string, target_id long, protocol string, key string, value string, created_at timestamp_ntz"


def orphaned(notes: DataFrame, pkts: DataFrame, streams: DataFrame) -> DataFrame:
    """``notes`` with the flag ``orphaned``. Targets are joined as distinct keys, so repeated ones don't multiply rows."""
    p = pkts.select(F.col("frame_number").alias("target_id"), F.lit("packet").alias("scope"), F.lit("").alias("p"))
    s = streams.select(F.col("stream_id").alias("target_id"), F.lit("stream").alias("scope"), F.col("protocol").alias("p"))
    targets = p.unionByName(s).distinct().withColumn("there", F.lit(True))
    out = notes.withColumn("p", F.coalesce("protocol", F.lit(""))).join(targets, ["target_id", "scope", "p"], "left")
    return out.select(*[notes[c] for c in notes.columns], F.col("there").isNull().alias("orphaned"))


def selected(scope: str | None, target_id: int | None, key: str | None, protocol: str | None) -> Column:
    """The condition of all criteria that are given."""
    if scope is not None and scope not in SCOPES:
        raise ValueError(f"{scope!r} isn't one of {SCOPES}")
    out = F.lit(True)
    for name, v in (("scope", scope), ("target_id", target_id), ("key", key), ("protocol", protocol)):
        if v is not None:
            out &= F.col(name).eqNullSafe(F.lit(v))
    return out
