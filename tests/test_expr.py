from datetime import timedelta
from ipaddress import IPv4Address

import pytest
from packets import HOST, LOAD, PAYLOAD, PORT, SRC, SYN, TIME, TTL

from wirelake.errors import UnsupportedExprError
from wirelake.expr import And, Comparison, FieldRef, Not, ValueRange, conjuncts, field_refs
from wirelake.plans.display import compile_display
from wirelake.plans.planner import make_plan


def test_no_truth_value():
    for bad in (lambda: bool(TTL == 1), lambda: (TTL == 1) and (TTL == 2), lambda: 1 < TTL < 3, lambda: 3 in TTL, lambda: hash(TTL)):
        with pytest.raises(TypeError):
            bad()


def test_inequality_is_a_negation():
    e = TTL != 5
    assert isinstance(e, Not) and isinstance(e.operand, Comparison) and e.operand.op == "=="


def test_equals_is_strict_about_types():
    assert (TTL == 1).equals(TTL == 1)
    assert not (TTL == 1).equals(TTL == True)  # noqa: E712
    assert not (TTL == 1).equals(TTL < 1)
    assert TTL.in_([1, (2, 3)]).equals(TTL.in_([1, ValueRange(2, 3)]))
    assert not TTL.in_([1, 2]).equals(TTL.in_([2, 1]))
    assert (~(TTL == 1) & HOST.contains("a")).equals(~(TTL == 1) & HOST.contains("a"))
    assert not HOST.contains("a").equals(HOST.contains(b"a"))


@pytest.mark.parametrize("bad, error", [
    (lambda: TTL == None, TypeError), (lambda: TTL == [1], TypeError), (lambda: TTL.in_([]), ValueError), (lambda: HOST.in_("abc"), TypeError),  # noqa: E711
    (lambda: TTL.in_([range(0, 9, 2)]), ValueError), (lambda: TTL.in_([range(0)]), ValueError), (lambda: TTL.in_([(1, 2, 3)]), TypeError),
    (lambda: HOST.contains(""), ValueError), (lambda: HOST.contains(3), TypeError), (lambda: HOST.matches(3), TypeError), (lambda: (TTL == 1) & 3, TypeError),
    (lambda: HOST.matches("a++"), ValueError), (lambda: HOST.matches("(?i)a"), ValueError), (lambda: HOST.matches("(?P<n>a)"), ValueError), (lambda: HOST.matches(r"\1(a)"), ValueError),
    (lambda: HOST.matches("[[:alpha:]]"), ValueError), (lambda: HOST.matches(r"\Aa"), ValueError), (lambda: HOST.matches("a{70000}"), ValueError), (lambda: HOST.matches("a{,3}"), ValueError), (lambda: HOST.matches("(a"), ValueError), (lambda: HOST.matches(r"\x4"), ValueError),
])
def test_refusals(bad, error):
    with pytest.raises(error):
        bad()


def test_traversals():
    e = (TTL == 1) & ((HOST == "a") & ~((TTL == 2) | PORT.present()))
    assert [type(x).__name__ for x in conjuncts(e)] == ["Comparison", "Comparison", "Not"]
    assert [f.name for f in field_refs(e)] == ["ip.ttl", "http.host", "ip.ttl", "tcp.port"]
    assert isinstance(e, And)


@pytest.mark.parametrize("e, text", [
    (SRC == "192.0.2.7", "ip.src == 192.0.2.7"), (SRC == IPv4Address("192.0.2.7"), "ip.src == 192.0.2.7"), (TTL >= 64, "ip.ttl >= 64"), (TTL != 64, "!(ip.ttl == 64)"), (SYN == True, "tcp.flags.syn == 1"),  # noqa: E712
    (LOAD < 1, "sys.load < 1.0"), (HOST == 'a"b\\\n\x01', 'http.host == "a\\"b\\\\\\n\\x01"'), (PAYLOAD == b"\x00\xff", "tcp.payload == 00:ff"), (PORT.present(), "tcp.port"),
    (PORT.in_([80, (1, 3), range(5, 8)]), "tcp.port in {80, 1 .. 3, 5 .. 7}"), (HOST.contains("x"), 'http.host contains "x"'), (PAYLOAD.contains(b"ab"), "tcp.payload contains 61:62"), (HOST.matches("^a.b$"), 'http.host matches "^a.b$"'),
    ((TTL == 1) & (TTL == 2) | ~PORT.present(), "((ip.ttl == 1) && (ip.ttl == 2)) || (!(tcp.port))"),
])
def test_display_filters(e, text):
    assert compile_display(e) == text


@pytest.mark.parametrize("e, error", [
    (TIME == "1.5", UnsupportedExprError), (PAYLOAD == b"", UnsupportedExprError), (TTL == True, TypeError), (TTL == 1.5, TypeError), (TTL == "x", ValueError), (PORT.in_([(5, 1)]), ValueError),  # noqa: E712
    (TTL.contains("a"), TypeError), (HOST.contains(b"a"), TypeError), (TTL.matches("a"), TypeError),
])
def test_display_refusals(e, error):
    with pytest.raises(error):
        compile_display(e)


def test_plans():
    late = TIME >= "1700000000"
    p = make_plan([(TTL == 1) & late, PORT == 80], select=[HOST, HOST, SRC])
    assert p.display == "(ip.ttl == 1) && (tcp.port == 80)" and p.mode == "fields"
    assert [f.name for f in p.projection] == ["http.host", "ip.src", "frame.time"] and len(p.residual) == 1
    assert make_plan([TTL == 1]).mode == "ek" and make_plan([lambda p: True], select=[HOST]).projection is None
    assert "pushed filter: (ip.ttl == 1)" in make_plan([TTL == 1]).explain()
    with pytest.raises(TypeError):
        make_plan([3])
    with pytest.raises(ValueError):
        make_plan([TTL == "x"])
    assert timedelta(0) == timedelta() and FieldRef("a").ftype == "FT_STRING"
