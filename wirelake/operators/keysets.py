"""Sets of row keys: duplicates, missing ones, equality, lists that cover others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, count) of keys that several rows have, least first."""
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter("count > 1").orderBy(key)
    return out if limit is None else out.limit(limit)


def missing(df: DataFrame, other: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Keys of ``df`` that ``other`` hasn't, least first."""
    out = df.filter(F.col(key).isNotNull()).select(key).join(other.select(key), key, "left_anti").orderBy(key)
    return out if limit is None else out.limit(limit)


def numbered(df: DataFrame, order: Sequence[str], name: str, start: int, stage: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``df`` with its rows' numbers from ``start`` in the order of the columns ``order``, and how many there are.

    Sorted parts are numbered each, and a part's numbers go on from those before: no task sees all rows, as with a window. ``stage`` keeps what
    is computed once.
    """
    at, low = F.col(name), (1 << 33) - 1
    parts = stage(df.orderBy(*[F.asc_nulls_last(c) for c in order]).withColumn(name, F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in parts.groupBy(F.shiftright(at, 33)).count().collect())
    offsets, n = [], 0
    for part, count in counts:
        offsets.append((part, start + n))
        n += count
    earlier = F.broadcast(df.sparkSession.createDataFrame(offsets, "wl_part long, wl_start long"))
    out = parts.join(earlier, F.shiftright(at, 33) == F.col("wl_part")).withColumn(name, F.col("wl_start") + at.bitwiseAND(F.lit(low)))
    return out.drop("wl_part", "wl_start"), n


@dataclass(frozen=True)
class Drift:
    """How two sets of row keys differ; the lists are examples."""

    null_keys: int
    repeated: tuple
    unknown: tuple
    unseen: tuple

    def __bool__(self) -> bool:
        return bool(self.null_keys or self.repeated or self.unknown or self.unseen)

    def __str__(self) -> str:
        says = ((f"{self.null_keys} scanned rows without a key", self.null_keys), (f"scanned several times: {list(self.repeated)}", self.repeated), (f"scanned but not stored: {list(self.unknown)}", self.unknown), (f"stored but not scanned: {list(self.unseen)}", self.unseen))
        return "; ".join(text for text, there in says if there)


def drift(scanned: DataFrame, stored: DataFrame, key: str, examples: int = 5) -> Drift:
    some = lambda df: tuple(r[0] for r in df.collect())
    return Drift(scanned.filter(F.col(key).isNull()).count(), some(duplicates(scanned, key, examples)), some(missing(scanned, stored, key, examples)), some(missing(stored, scanned, key, examples)))


def covers(stored: Column, wanted: Sequence | Column) -> Column:
    """Whether the array ``stored`` has all of ``wanted``."""
    w = wanted if isinstance(wanted, Column) else F.array(*[F.lit(x) for x in wanted])
    return F.size(F.array_except(w, stored)) == 0
