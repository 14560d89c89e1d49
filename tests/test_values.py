from datetime import UTC, datetime, timedelta
from ipaddress import IPv4Address, IPv6Address

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wirelake.ftypes import EPOCH, coerce, decode, field_type, from_text, interval_text, ipv6_decimal, occurrences

GOOD = {
    "FT_UINT8": ["0", " 255 ", "0x1F", "+7"], "FT_INT32": ["-5", "-0x10"], "FT_UINT64": ["18446744073709551615", "0xffffffffffffffff"], "FT_INT64": ["-9223372036854775808"],
    "FT_IPv4": ["10.0.0.1", "255.255.255.255", "0.0.0.0"], "FT_IPv6": ["2001:db8::1", "::", "fe80::1"], "FT_ETHER": ["aa:bb:cc:dd:ee:ff", "AABBCCDDEEFF"], "FT_BYTES": ["00:01:02", "", "ab cd"],
    "FT_BOOLEAN": ["1", "True", "true", "0", "False", "false"], "FT_ABSOLUTE_TIME": ["1700000000.123456789", "-1.9999999", ".5", "5.", "0"], "FT_RELATIVE_TIME": ["1.5", "-0.0000019", "86400"],
    "FT_DOUBLE": ["1.5", "-1e10", ".5", "inf", "-5"], "FT_STRING": ["", " a ", "é"], "FT_UNHEARD_OF": ["x"],
}
BAD = {
    "FT_UINT8": ["", "x", "0x", "1.5", "300000"], "FT_IPv4": ["10.0.0", "10.0.0.256", "010.0.0.1", ""], "FT_ETHER": ["aa:bb", "aa:bb:cc:dd:ee:ff:00", "gg:bb:cc:dd:ee:ff"], "FT_BYTES": ["0", "zz"],
    "FT_BOOLEAN": ["yes", "TRUE", ""], "FT_ABSOLUTE_TIME": ["", ".", "1.2.3", "1e5", "now"], "FT_RELATIVE_TIME": ["-", "+."], "FT_DOUBLE": ["", "1.5d", "abc"],
}


@pytest.mark.parametrize("ftype", GOOD)
def test_columns_parse_as_python_does(spark, ftype):
    df = spark.createDataFrame([(t,) for t in GOOD[ftype]] + [(None,)], "t string")
    got = [decode(ftype, r[0]) for r in df.select(from_text(F.col("t"), ftype, "f")).collect()]
    assert got == [field_type(ftype).parse(t) for t in GOOD[ftype]] + [None]


@pytest.mark.parametrize("ftype, text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_malformed_text_is_loud(spark, ftype, text):
    if text != "300000":  # too wide for the column only
        with pytest.raises(ValueError):
            field_type(ftype).parse(text)
    with pytest.raises(PySparkException, match="the.field"):
        spark.createDataFrame([(text,)], "t string").select(from_text(F.col("t"), ftype, "the.field")).collect()


def test_occurrences(spark):
    df = spark.createDataFrame([(["80", "443"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(occurrences(F.col("a"), "FT_UINT16", True, "p")).collect()] == [[80, 443], [], []]
    with pytest.raises(PySparkException, match="occurs 2 times"):
        df.select(occurrences(F.col("a"), "FT_UINT16", False, "p")).collect()
    with pytest.raises(PySparkException):  # an empty occurrence among several isn't a number
        spark.createDataFrame([(["", ""],)], "a array<string>").select(occurrences(F.col("a"), "FT_UINT16", True, "p")).collect()
    six = spark.createDataFrame([(["::1", "::2"],), ([],)], "a array<string>").select(occurrences(F.col("a"), "FT_IPv6", True, "p")).collect()
    assert [list(map(bytes, r[0])) for r in six] == [[IPv6Address("::1").packed, IPv6Address("::2").packed], []]


def test_coercion():
    assert coerce("FT_IPv4", "10.0.0.1") == IPv4Address("10.0.0.1") and coerce("FT_DOUBLE", 3) == 3.0 and coerce("FT_BOOLEAN", "1") is True
    for ftype, v in (("FT_UINT8", True), ("FT_UINT8", 1.0), ("FT_STRING", 3), ("FT_IPv4", 3), ("FT_BYTES", 3)):
        with pytest.raises(TypeError):
            coerce(ftype, v)
    assert field_type("FT_ABSOLUTE_TIME").parse("-1.5") == EPOCH - timedelta(seconds=1.5) and EPOCH == datetime(1970, 1, 1, tzinfo=UTC)


def test_portable_text(spark):
    spans = [timedelta(0), timedelta(seconds=1.5), timedelta(days=1, seconds=61), timedelta(days=3), -timedelta(days=2, microseconds=1)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in spans], "d interval day to second").select(interval_text(F.col("d"))).collect()]
    assert got == ["00:00:00", "00:00:01.500000", "1 day 00:01:01", "3 days 00:00:00", "-2 days 00:00:00.000001"]
    six = IPv6Address("ffff::1")
    assert spark.createDataFrame([(bytearray(six.packed),)], "b binary").select(ipv6_decimal("b")).first()[0] == str(int(six))
