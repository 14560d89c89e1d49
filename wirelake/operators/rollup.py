"""Conversations: packets rolled up by protocol and stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROTOCOLS = ("tcp", "udp")
REQUIRED = tuple(sorted(("frame.len", "ip.src", "ip.dst", *(f"{p}.{x}" for p in PROTOCOLS for x in ("stream", "srcport", "dstport")))))
_ENDS = ("src_addr", "src_port", "dst_addr", "dst_port")


def first_occurrence(c: Column) -> Column:
    """The first of an array column; null past its end."""
    return F.get(c, F.lit(0))


def streams(pkts: DataFrame, values: Mapping[str, Column], key: str = "frame_number", time: str = "frame_time") -> DataFrame:
    """One row for each (protocol, stream_id): ends as in the first packet (nulls kept), first and last packet, counts.

    ``values`` has a column for each of ``REQUIRED``. A packet belongs to at most one stream of each protocol; one shuffle rolls up both:
    the packet's streams are an array that is exploded, and the aggregation combines before it shuffles.
    """
    one = [
        F.when(values[f"{p}.stream"].isNotNull(), F.struct(F.lit(p).alias("protocol"), values[f"{p}.stream"].cast("long").alias("stream_id"), values[f"{p}.srcport"].cast("int").alias("src_port"), values[f"{p}.dstport"].cast("int").alias("dst_port")))
        for p in PROTOCOLS
    ]
    each = pkts.select(F.col(key).alias("n"), F.col(time).alias("t"), values["frame.len"].cast("long").alias("bytes"), values["ip.src"].alias("src_addr"), values["ip.dst"].alias("dst_addr"), F.explode(F.array_compact(F.array(*one))).alias("s"))
    each = each.select("n", "t", "bytes", "src_addr", "dst_addr", "s.*")
    return rolled(each, ["protocol", "stream_id"], _ENDS, "n", "t", "bytes")


def rolled(each: DataFrame, by: list[str], firsts: tuple[str, ...], key: str, time: str, size: str) -> DataFrame:
    """Groups of packets: ``firsts`` are those of the packet of least ``key``, even if null.

    Each is an aggregate of its own: of numbers, these run as hash aggregation, where one of a struct would sort.
    """
    return each.groupBy(*by).agg(
        *[F.min_by(c, key).alias(c) for c in firsts],
        F.min(key).alias("first_frame"), F.max(key).alias("last_frame"), F.count(F.lit(1)).alias("pkt_count"), F.sum(size).alias("byte_count"),
        F.min(time).alias("first_time"), F.max(time).alias("last_time"),
    )


def duration(first: Column, last: Column) -> Column:
    """A day-time interval; aggregates work on it directly."""
    return last - first
