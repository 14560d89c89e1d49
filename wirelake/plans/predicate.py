"""Expressions as Python predicates over raw packets: for what remains after pushdown in row-wise use, and as the tests' brute force."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence

from wirelake.expr import And, Comparison, Contains, Expr, Matches, Membership, Not, Or, Presence
from wirelake.ftypes import coerce, field_type
from wirelake.plans import leaves

#: Field name to its raw occurrences; no entry is the same as none.
Raw = Mapping[str, Sequence[str]]
_OPS = dict(zip(("==", "<", "<=", ">", ">="), (operator.eq, operator.lt, operator.le, operator.gt, operator.ge)))


def compile_predicate(e: Expr) -> Callable[[Raw], bool]:
    if isinstance(e, Not):
        inner = compile_predicate(e.operand)
        return lambda p: not inner(p)
    if isinstance(e, And | Or):
        a, b = compile_predicate(e.left), compile_predicate(e.right)
        return (lambda p: a(p) and b(p)) if isinstance(e, And) else (lambda p: a(p) or b(p))
    if isinstance(e, Presence):
        return lambda p: bool(p.get(e.field.name))
    passes = _occurrence(e)
    parse = field_type(e.field.ftype).parse
    return lambda p: any(passes(parse(raw)) for raw in p.get(e.field.name, ()))


def _occurrence(e: Expr) -> Callable[[object], bool]:
    if isinstance(e, Comparison):
        op, v = _OPS[e.op], coerce(e.field.ftype, e.value)
        return lambda x: op(x, v)
    if isinstance(e, Membership):
        single, ranges = leaves.members(e)
        return lambda x: any(x == v for v in single) or any(a <= x <= b for a, b in ranges)
    if isinstance(e, Contains):
        n = leaves.needle(e)
        return lambda x: n in x
    if isinstance(e, Matches):
        found = re.compile(leaves.pattern(e).encode(), re.I).search
        return lambda x: found(x.encode("utf-8", "surrogatepass")) is not None
    raise leaves.unknown(e)
