"""Field types: the Python value each holds, the Spark type of its column, and how text becomes either.

A field type is looked up by its dissector name (``FT_IPv4``, ``FT_UINT16``, ...); names that aren't listed are text.
Unsigned integers take the next wider signed type; IPv4 addresses are integers and IPv6 addresses 16 big-endian bytes,
so that a subnet is a range on either.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from ipaddress import IPv4Address, IPv6Address

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_CLOCK = re.compile(r"([+-]?)(\d*)(?:\.(\d*))?", re.ASCII)


def _text_int(raw: str) -> int:
    s = raw.strip()
    return int(s, 16 if s.lstrip("+-")[:2] in ("0x", "0X") else 10)


def _text_bytes(raw: str) -> bytes:
    try:
        return bytes.fromhex(raw.strip().replace(":", ""))
    except ValueError:
        raise ValueError(f"not a byte string: {raw!r}") from None


def _text_mac(raw: str) -> bytes:
    if len(b := _text_bytes(raw)) != 6:
        raise ValueError(f"a hardware address has 6 bytes, this has {len(b)}: {raw!r}")
    return b


_TRUTH = {"1": True, "True": True, "true": True, "0": False, "False": False, "false": False}


def _text_bool(raw: str) -> bool:
    if raw not in _TRUTH:
        raise ValueError(f"not a truth value: {raw!r}")
    return _TRUTH[raw]


def _text_span(raw: str) -> timedelta:
    """Seconds with a fraction; digits beyond microseconds are cut, so negative values go towards zero."""
    m = _CLOCK.fullmatch(raw.strip())
    if not m or not (m[2] or m[3]):
        raise ValueError(f"not seconds: {raw!r}")
    span = timedelta(seconds=int(m[2] or 0), microseconds=int(((m[3] or "") + "000000")[:6]))
    return -span if m[1] == "-" else span


@dataclass(frozen=True)
class FieldType:
    """``python``: type of values; ``parse``: text to value, ValueError if malformed; ``spark``: type of the column."""

    python: type
    parse: Callable[[str], object]
    spark: T.DataType


_SPAN = T.DayTimeIntervalType(T.DayTimeIntervalType.DAY, T.DayTimeIntervalType.SECOND)
_TEXT = FieldType(str, str, T.StringType())
_INTEGERS = {
    "FT_UINT8": T.ShortType(), "FT_CHAR": T.ShortType(), "FT_UINT16": T.IntegerType(), "FT_UINT24": T.LongType(), "FT_UINT32": T.LongType(), "FT_FRAMENUM": T.LongType(),
    "FT_UINT40": T.LongType(), "FT_UINT48": T.LongType(), "FT_UINT56": T.LongType(), "FT_UINT64": T.DecimalType(20, 0),
    "FT_INT8": T.ByteType(), "FT_INT16": T.ShortType(), "FT_INT24": T.IntegerType(), "FT_INT32": T.IntegerType(),
    "FT_INT40": T.LongType(), "FT_INT48": T.LongType(), "FT_INT56": T.LongType(), "FT_INT64": T.LongType(),
}
FIELD_TYPES: dict[str, FieldType] = {
    **{k: FieldType(int, _text_int, v) for k, v in _INTEGERS.items()},
    "FT_IPv4": FieldType(IPv4Address, IPv4Address, T.LongType()),
    "FT_IPv6": FieldType(IPv6Address, IPv6Address, T.BinaryType()),
    "FT_ETHER": FieldType(bytes, _text_mac, T.BinaryType()),
    "FT_BYTES": FieldType(bytes, _text_bytes, T.BinaryType()),
    "FT_BOOLEAN": FieldType(bool, _text_bool, T.BooleanType()),
    "FT_ABSOLUTE_TIME": FieldType(datetime, lambda raw: EPOCH + _text_span(raw), T.TimestampNTZType()),
    "FT_RELATIVE_TIME": FieldType(timedelta, _text_span, _SPAN),
    "FT_DOUBLE": FieldType(float, float, T.DoubleType()),
    "FT_FLOAT": FieldType(float, float, T.DoubleType()),
}


def field_type(ftype: str) -> FieldType:
    return FIELD_TYPES.get(ftype, _TEXT)


def column_type(ftype: str, multi: bool) -> T.DataType:
    t = field_type(ftype).spark
    return T.ArrayType(t, True) if multi else t


def coerce(ftype: str, value: object) -> object:
    """``value`` as the field's Python type: text is parsed, whole numbers do for floating-point fields, truth values only for truth fields."""
    want = field_type(ftype).python
    if isinstance(value, bool) and want is not bool:
        raise TypeError(f"{ftype} takes {want.__name__}, not the truth value {value!r}")
    if isinstance(value, want):
        return value
    if isinstance(value, str):
        return field_type(ftype).parse(value)
    if want is float and isinstance(value, int):
        return float(value)
    raise TypeError(f"{ftype} takes {want.__name__} or its text, not {type(value).__name__} {value!r}")


def naive_utc(t: datetime) -> datetime:
    """Naive times are UTC already."""
    return t if t.tzinfo is None else t.astimezone(UTC).replace(tzinfo=None)


def storable(value: object) -> object:
    """A value in the form in which columns hold it."""
    if isinstance(value, IPv4Address):
        return int(value)
    if isinstance(value, IPv6Address):
        return value.packed
    if isinstance(value, datetime):
        return naive_utc(value)
    return value


def literal(value: object) -> Column:
    """A literal of a coerced value. Integers keep their own width, so a value beyond the column's range compares, and is unequal."""
    v = storable(value)
    if isinstance(v, datetime):
        return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(v, bytes):
        return F.lit(bytearray(v))
    if isinstance(v, int) and not isinstance(v, bool) and not -(2**63) <= v < 2**63:
        most = 10**38 - 1
        return F.lit(Decimal(max(-most, min(most, v)))).cast("decimal(38,0)")
    return F.lit(v)


def is_nan(value: object) -> bool:
    return isinstance(value, float) and math.isnan(value)


def decode(ftype: str, value: object) -> object:
    """The Python value of what a column holds; None stays."""
    if value is None:
        return None
    want = field_type(ftype).python
    if want is IPv4Address:
        return IPv4Address(value)
    if want is IPv6Address:
        return IPv6Address(bytes(value))
    if want is datetime:
        return value.replace(tzinfo=UTC)
    if want is bytes:
        return bytes(value)
    return int(value) if want is int else value


# Text columns to typed columns. Malformed text is an error that names the field.

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = "^" + r"\.".join([_OCTET] * 4) + "$"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"


@F.pandas_udf(T.BinaryType())
def _ipv6_bytes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else IPv6Address(t).packed)


def _micros(s: Column) -> Column:
    p = r"^\s*([+-]?)([0-9]*)(?:\.([0-9]*))?\s*$"
    frac = F.rpad(F.substring(F.regexp_extract(s, p, 3), 1, 6), 6, "0")
    whole = F.concat(F.lit("0"), F.regexp_extract(s, p, 2)).cast("decimal(18,0)") * F.lit(1_000_000).cast("decimal(8,0)") + frac.cast("decimal(7,0)")
    signed = F.when(F.regexp_extract(s, p, 1) == "-", -whole).otherwise(whole).try_cast("long")
    return F.when(s.rlike(p) & s.rlike("[0-9]"), signed)


def _interval(micros: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(24,6)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def from_text(s: Column, ftype: str, name: str) -> Column:
    """A value column from a text column; null stays null, malformed text raises."""
    t = field_type(ftype)
    want = t.python
    if want is str:
        return s
    if want is IPv6Address:
        return _ipv6_bytes(s)
    if want is IPv4Address:
        part = lambda i: F.regexp_extract(s, _IPV4, i).cast("long")
        value = F.when(s.rlike(_IPV4), part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))
    elif want is bytes:
        h = F.regexp_replace(F.trim(s), ":", "")
        n = "{6}" if ftype == "FT_ETHER" else "*"
        value = F.when(h.rlike(rf"^(?:[0-9a-fA-F]{{2}}\s*){n}$"), F.unhex(F.regexp_replace(h, r"\s+", "")))
    elif want is bool:
        value = F.when(s.isin("1", "True", "true"), True).when(s.isin("0", "False", "false"), False)
    elif want is datetime:
        value = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + _interval(_micros(s))
    elif want is timedelta:
        value = _interval(_micros(s))
    elif want is float:
        value = F.when(s.rlike(_NUMBER), F.trim(s).try_cast("double"))
    else:
        hexed = r"^\s*([+-]?)0[xX]([0-9a-fA-F]{1,16})\s*$"
        number = F.conv(F.regexp_extract(s, hexed, 2), 16, 10).cast("decimal(20,0)")
        number = F.when(F.regexp_extract(s, hexed, 1) == "-", -number).otherwise(number)
        plain = F.when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(F.regexp_replace(s, r"\s", "")).try_cast("decimal(38,0)"))
        value = F.when(s.rlike(hexed), number).otherwise(plain).try_cast(t.spark)
    wrong = F.raise_error(F.concat(F.lit(f"{name} ({ftype}): malformed value "), s)).cast(t.spark)
    return F.when(s.isNull(), F.lit(None).cast(t.spark)).otherwise(F.coalesce(value, wrong))


def occurrences(raw: Column, ftype: str, multi: bool, name: str) -> Column:
    """A field's column from its raw occurrences (array of text). A field declared single that occurs more than once raises."""
    t = field_type(ftype)
    if multi:
        if t.python is str:
            return F.coalesce(raw, F.array().cast("array<string>"))
        if t.python is IPv6Address:
            return _ipv6_arrays(F.coalesce(raw, F.array().cast("array<string>")))
        return F.coalesce(F.transform(raw, lambda s: from_text(s, ftype, name)), F.array().cast(T.ArrayType(t.spark)))
    many = F.raise_error(F.concat(F.lit(f"{name} is declared single but occurs "), F.size(raw).cast("string"), F.lit(" times"))).cast("string")
    return from_text(F.when(F.size(raw) > 1, many).otherwise(F.get(raw, F.lit(0))), ftype, name)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _ipv6_arrays(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ts: [IPv6Address(t).packed for t in ts])


# Columns to text, for exports of types that other engines lack.


@F.pandas_udf(T.StringType())
def ipv6_decimal(b: pd.Series) -> pd.Series:
    """An IPv6 address's number in decimal: it doesn't fit 38 digits."""
    return b.map(lambda x: None if x is None else str(int.from_bytes(x, "big")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def ipv6_decimals(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: None if xs is None else [None if x is None else str(int.from_bytes(x, "big")) for x in xs])


def interval_text(x: Column) -> Column:
    """``[-][N day[s] ]HH:MM:SS[.ffffff]``."""
    us = F.abs((F.extract(F.lit("DAY"), x).cast("long") * 86_400_000_000) + F.extract(F.lit("HOUR"), x).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), x).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("long"))
    days, rest = F.floor(us / 86_400_000_000), us % 86_400_000_000
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    head = F.when(days == 0, F.lit("")).otherwise(F.concat(days.cast("string"), F.when(days == 1, F.lit(" day ")).otherwise(F.lit(" days "))))
    clock = F.concat_ws(":", two(F.floor(rest / 3_600_000_000)), two(F.floor(rest / 60_000_000) % 60), two(F.floor(rest / 1_000_000) % 60))
    frac = F.when(us % 1_000_000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0")))
    sign = F.when(x < F.expr("interval '0' second"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, head, clock, frac)
