"""Expressions as Spark columns.

Negations are moved to the leaves, where each has a form of its own: so no subtree of three values is ever negated, and scans get
filters they can push down (``Not(EqualNullSafe)``, ``Or(IsNull, ...)``). In a filter, null counts as false, which is what a positive leaf
of an absent field has to be; ``total`` turns null into false for use as a value.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelake import regexes
from wirelake.errors import UnsupportedSqlExprError
from wirelake.expr import And, Comparison, Contains, Expr, FieldRef, Matches, Membership, Not, Or, Presence
from wirelake.ftypes import coerce, field_type, is_nan, literal
from wirelake.plans import leaves

Resolve = Callable[[FieldRef], Column]
_INVERSE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def compile_column(e: Expr, resolve: Resolve, *, total: bool = False, strict_portable: bool = False) -> Column:
    """``e`` as a boolean column over the columns that ``resolve`` has for fields. ``strict_portable`` refuses what linear-time regex engines would."""
    c = _compile(e, resolve, False, strict_portable)
    return F.coalesce(c, F.lit(False)) if total else c


def _order(op: str, x: Column, v: Column, floating: bool) -> Column:
    c = {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op]
    return c & ~F.isnan(x) if floating and op in (">", ">=") else c  # Spark has NaN above all numbers


def _compile(e: Expr, resolve: Resolve, negated: bool, strict: bool) -> Column:
    if isinstance(e, Not):
        return _compile(e.operand, resolve, not negated, strict)
    if isinstance(e, And | Or):
        a, b = (_compile(x, resolve, negated, strict) for x in (e.left, e.right))
        return a & b if isinstance(e, And) != negated else a | b
    if not isinstance(e, Comparison | Presence | Membership | Contains | Matches):
        raise leaves.unknown(e)
    x = resolve(e.field)
    if isinstance(e, Presence):
        if e.field.multi:
            size = F.size(F.coalesce(x, F.expr("array()")))
            return size == 0 if negated else size > 0
        return x.isNull() if negated else x.isNotNull()
    if isinstance(e, Comparison) and not e.field.multi:
        return _scalar(e, x, negated)
    test = _test(e, strict)
    if not e.field.multi:
        c = test(x)
    elif isinstance(e, Comparison) and e.op == "==" and not is_nan(v := coerce(e.field.ftype, e.value)):
        c = F.array_contains(x, literal(v))
    else:
        c = F.exists(x, test)
    return ~F.coalesce(c, F.lit(False)) if negated else c


def _scalar(e: Comparison, x: Column, negated: bool) -> Column:
    value = coerce(e.field.ftype, e.value)
    if is_nan(value):
        return F.lit(negated)  # nothing compares with NaN
    v, floating = literal(value), field_type(e.field.ftype).python is float
    if e.op == "==":
        return ~x.eqNullSafe(v) if negated else x == v
    if not negated:
        return _order(e.op, x, v, floating)
    c = x.isNull() | {">=": x >= v, ">": x > v, "<=": x <= v, "<": x < v}[_INVERSE[e.op]]
    # NaN fails every comparison. isnan also keeps this from the scan: files' statistics may leave NaN out.
    return c | F.isnan(x) if floating else c


def _test(e: Expr, strict: bool) -> Callable[[Column], Column]:
    """The leaf on one occurrence."""
    if isinstance(e, Comparison):
        value = coerce(e.field.ftype, e.value)
        floating = field_type(e.field.ftype).python is float
        if is_nan(value):
            return lambda x: F.lit(False)
        v = literal(value)
        return (lambda x: x == v) if e.op == "==" else lambda x: _order(e.op, x, v, floating)
    if isinstance(e, Membership):
        single, ranges = leaves.members(e)
        single = [literal(v) for v in single if not is_nan(v)]
        ranges = [(literal(a), literal(b)) for a, b in ranges if not (is_nan(a) or is_nan(b))]
        floating = field_type(e.field.ftype).python is float

        def member(x: Column) -> Column:
            tests = ([x.isin(*single)] if single else []) + [x.between(a, b) & ~F.isnan(x) if floating else x.between(a, b) for a, b in ranges]
            out = tests[0] if tests else F.lit(False)
            for t in tests[1:]:
                out |= t
            return out

        return member
    if isinstance(e, Contains):
        n = literal(leaves.needle(e))
        return lambda x: F.contains(x, n)
    p = leaves.pattern(e)
    if strict:
        if why := regexes.unportable(p):
            raise UnsupportedSqlExprError(f"{e.field.name} matches {p!r}: {why}")
    if regexes.overflows(p):
        if e.field.multi:
            raise _Listwise(p)
        return _python_search(p)
    java = regexes.for_jvm(p)
    if not regexes.wants_bytes(p):
        return lambda x: x.rlike(java)
    return lambda x: F.decode(F.encode(x, "UTF-8"), "ISO-8859-1").rlike(java)


class _Listwise(Exception):
    """The pattern needs Python, on whole lists: lambdas can't hold Python functions."""


def _python_search(p: str, many: bool = False):
    @F.pandas_udf("boolean")
    def search(values: pd.Series) -> pd.Series:
        found = re.compile(p.encode(), re.I).search
        one = lambda t: t is not None and found(t.encode("utf-8", "surrogatepass")) is not None
        return values.map((lambda ts: ts is not None and any(map(one, ts))) if many else (lambda t: None if t is None else one(t)))

    return search


def _compile_leafwise(e: Expr, resolve: Resolve, negated: bool, strict: bool) -> Column:
    try:
        return _plain_compile(e, resolve, negated, strict)
    except _Listwise as x:
        c = F.coalesce(_python_search(x.args[0], True)(resolve(e.field)), F.lit(False))
        return ~c if negated else c


_plain_compile, _compile = _compile, _compile_leafwise
