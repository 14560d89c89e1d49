"""Columns against the Python predicate, row by row: fixed cases and random trees."""

import random
import re

import pytest
from packets import DST, HOST, LOAD, LOADS, PAYLOAD, PORT, QRY, RTT, SIX, SPORT, SRC, SYN, TIME, TTL, raw_frame
from pyspark.sql import functions as F

from wirelake import regexes
from wirelake.expr import FieldRef
from wirelake.ftypes import occurrences
from wirelake.plans.columns import compile_column
from wirelake.plans.predicate import compile_predicate

REFS = (SRC, DST, PORT, TTL, HOST, QRY, TIME, PAYLOAD, LOAD, LOADS, SIX, SYN, RTT, SPORT)
ROWS = [
    {},
    {"ip.src": ["10.0.0.1"], "ip.dst": ["10.0.0.2"], "tcp.port": ["51234", "443"], "ip.ttl": ["64"], "http.host": ["Example.COM"], "frame.time": ["1700000000.5"], "tcp.payload": ["de:ad:be:ef"], "sys.load": ["0.5"], "tcp.flags.syn": ["1"], "tcp.rtt": ["0.25"], "tcp.srcport": ["51234"]},
    {"ip.src": ["10.0.0.2"], "tcp.port": ["80"], "ip.ttl": ["1"], "http.host": [""], "sys.load": ["nan"], "sys.loads": ["nan", "0.1"], "tcp.flags.syn": ["0"]},
    {"ip.src": ["192.168.1.1"], "ip.ttl": ["255"], "http.host": ["näïve\nhöst.example"], "dns.qry.name": ["a.example", "B.example"], "sys.loads": ["nan"], "ipv6.src": ["2001:db8::1"], "tcp.rtt": ["-1"]},
    {"ipv6.src": ["fe80::1"], "dns.qry.name": ["", "x\r"], "sys.loads": ["1.5", "2.5"], "sys.load": ["inf"], "frame.time": ["0"], "tcp.payload": ["00"]},
    {"ipv6.src": ["::"], "http.host": ["abc\x85"], "dns.qry.name": ["ÉA.example"], "tcp.port": ["0", "65535"], "ip.ttl": ["0"], "sys.load": ["-1"], "tcp.payload": ["ad:be"]},
]


@pytest.fixture(scope="module")
def typed(spark):
    raw = raw_frame(spark, ROWS, REFS)
    return raw.select("i", *[occurrences(F.col(f"`{r.name}`"), r.ftype, r.multi, r.name).alias(r.name) for r in REFS]).coalesce(1).cache()


def check(typed, exprs):
    resolve = lambda r: F.col(f"`{r.name}`")
    got = typed.orderBy("i").select(*[compile_column(e, resolve, total=True).alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    for k, e in enumerate(exprs):
        want = [compile_predicate(e)(p) for p in ROWS]
        assert [r[k] for r in got] == want, e


LEAVES = [
    SRC == "10.0.0.1", SRC != "10.0.0.1", SRC < "10.0.0.2", SRC >= "10.0.0.2", SRC.in_([("10.0.0.0", "10.0.0.255")]), SRC.in_(["10.0.0.1", "192.168.1.1"]), SRC.present(),
    PORT == 443, PORT != 443, PORT < 100, PORT <= 80, PORT > 60000, PORT >= 65535, PORT.in_([(1, 100), 443]), PORT.in_([range(400, 444)]), PORT.present(),
    TTL == 70000, TTL < 70000, TTL == -1, TTL > 2**70, TTL < 2**70, TTL <= 64, TTL > 64,
    HOST == "Example.COM", HOST.contains("ample"), HOST.contains("é"), HOST.contains("ö"), HOST.matches("^example"), HOST.matches("^$"), HOST.matches("h.st"), HOST.matches("h..st"), HOST.matches("^abc$"), HOST.matches(r"\bexample"), HOST.matches(r"e\b"), HOST.matches("[^a-z]h"), HOST.matches("(?:a|m)+p"), HOST.matches("(?:ab?)*c"), HOST < "a", HOST >= "Example",
    QRY == "a.example", QRY != "a.example", QRY.contains("example"), QRY.matches("^b"), QRY.matches("^É"), QRY.matches("^é"), QRY.matches("x$"), QRY.matches("(?:[a-z]|\\.)+e$"), QRY.in_(["", "zz"]), QRY > "a", QRY.present(),
    TIME >= "1700000000", TIME == "1700000000.5", TIME.in_([("0", "1")]), PAYLOAD == b"\x00", PAYLOAD.contains(b"\xad\xbe"), PAYLOAD < b"\x80", PAYLOAD.present(),
    LOAD > 0, LOAD >= 0.5, LOAD < 1, LOAD <= 0.5, LOAD == 0.5, LOAD == float("nan"), LOAD != float("nan"), LOAD < float("nan"), LOAD.in_([(0.0, float("inf"))]), LOAD.in_([float("nan"), 0.5]),
    LOADS > 0, LOADS >= 2.5, LOADS < 0.2, LOADS == 0.1, LOADS.in_([(0.0, 9.0)]), LOADS == float("nan"),
    SIX == "2001:db8::1", SIX > "7fff::", SIX <= "::", SIX.in_([("2001:db8::", "2001:db8::ffff")]), SYN == True, SYN == "0", SYN.present(), RTT > "0", RTT <= "0.25", RTT.in_([("-2", "-1")]),  # noqa: E712
]


def test_leaves(typed):
    check(typed, LEAVES)


def test_negated_leaves(typed):
    check(typed, [~e for e in LEAVES])


def test_doubly_negated_leaves(typed):
    check(typed, [~~e for e in LEAVES])


def test_random_trees(typed):
    r = random.Random(7)

    def tree(depth):
        if depth == 0 or r.random() < 0.25:
            return r.choice(LEAVES)
        k = r.random()
        return ~tree(depth - 1) if k < 0.3 else tree(depth - 1) & tree(depth - 1) if k < 0.65 else tree(depth - 1) | tree(depth - 1)

    for _ in range(4):
        check(typed, [tree(4) for _ in range(40)])


@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_patterns_against_python_bytes(spark):
    r = random.Random(11)
    atoms = ["a", "b", "é", ".", r"\d", r"\w", r"\s", r"\W", r"\b", "[a-c]", "[^a]", "[]a]", "[a&&b]", r"\.", r"\xc3", "(?:ab|c)", "(?=a)", "(?!b)", "^", "$", "x", "-", "[é]"]
    quantifiers = ["", "", "", "*", "+", "?", "{2}", "{1,3}", "*?"]
    patterns = []
    while len(patterns) < 150:
        p = "".join(r.choice(atoms) + r.choice(quantifiers) for _ in range(r.randint(1, 4)))
        try:
            regexes.validate(p)
            re.compile(p.encode())
        except (ValueError, re.error):
            continue
        patterns.append(p)
    values = ["", "a", "ab", "abc", "é", "aé", "éa", "a\n", "a\r", "a\nb", "x-1 b", "AB", "É", "K", "ſ", "a.b", "&", "]", " \x85", "日本", "aaa bbb"]
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    f = FieldRef("v")
    got = df.select(*[compile_column(f.matches(p), lambda _: F.col("v")).alias(f"c{i}") for i, p in enumerate(patterns)]).collect()
    for i, p in enumerate(patterns):
        want = [re.search(p.encode(), v.encode(), re.I) is not None for v in values]
        assert [row[i] for row in got] == want, p


def test_recursion_is_kept_from_the_jvm():
    for p in ("(?:a|b)*", "(?:a|b)*?", "(?:ab?)*", "(?:a.*?b)*", "(?:a+b+)+", "(?:a|b){5000}", r"(?:.|\n){2000}", "((?:a|b)c)*"):
        assert regexes.overflows(p), p
    for p in ("[ab]*", ".*b", "(?:ab)*", "(ab)*", "(?:[a-z][a-z])*", "(?:a|b){200}", "a|b", "(?:a|b)?"):
        assert not regexes.overflows(p), p


def test_strict_mode_refuses_what_linear_engines_do():
    assert regexes.unportable("(?=a)b") and regexes.unportable("é") and regexes.unportable("a{1001}") and regexes.unportable("(?:a{100}){100}")
    assert regexes.unportable("(?:a{10}){10}") is None and regexes.unportable("[(?=]") is None


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id AS u", "CAST(id AS DOUBLE) AS d").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda e: df.filter(compile_column(e, lambda r: F.col(r.name)))._jdf.queryExecution().executedPlan().toString()
    u, d = FieldRef("u", "FT_INT64"), FieldRef("d", "FT_DOUBLE")
    assert "Not(EqualNullSafe(u,5))" in plan(u != 5)
    assert "Or(IsNull(u),GreaterThanOrEqual(u,5))" in plan(~(u < 5))
    assert "PushedFilters: []" in plan(~(d >= 5)) and "PushedFilters: []" in plan(~(d < 5))  # files' statistics may leave NaN out
    assert "GreaterThan(d,5.0)" in plan(d > 5)
    assert "In(u, [1,2,3])" in plan(u.in_([1, 2, 3])) and "GreaterThanOrEqual(u,1)" in plan(u.in_([(1, 3)]))
    assert "ReadSchema: struct<u:bigint>" in df.filter(compile_column(u == 5, lambda r: F.col(r.name))).select("u")._jdf.queryExecution().executedPlan().toString()
