"""Expressions as Spark SQL with ``?`` parameters, for inspection and for ``spark.sql(text, args)``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from wirelake import regexes
from wirelake.errors import UnsupportedSqlExprError
from wirelake.expr import And, Comparison, Contains, Expr, FieldRef, Matches, Membership, Not, Or, Presence
from wirelake.ftypes import coerce, field_type, is_nan, storable
from wirelake.plans import leaves


def identifier(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def compile_sql(e: Expr, resolve: Callable[[FieldRef], str]) -> tuple[str, list]:
    """(condition, parameters); values are always parameters. Leaves under a negation are made two-valued there."""
    args: list = []

    def bind(v: object) -> str:
        v = storable(v)
        args.append(v.isoformat(sep=" ") if isinstance(v, datetime) else bytearray(v) if isinstance(v, bytes) else v)
        return "CAST(? AS TIMESTAMP_NTZ)" if isinstance(v, datetime) else "?"

    def one(e: Expr, x: str) -> str:
        floating = field_type(e.field.ftype).python is float
        if isinstance(e, Comparison):
            v = coerce(e.field.ftype, e.value)
            if is_nan(v):
                return "FALSE"
            text = f"{x} {'=' if e.op == '==' else e.op} {bind(v)}"
            return f"({text} AND NOT isnan({x}))" if floating and e.op in (">", ">=") else text
        if isinstance(e, Membership):
            single, ranges = leaves.members(e)
            parts = [f"{x} = {bind(v)}" for v in single if not is_nan(v)]
            parts += [f"{x} BETWEEN {bind(a)} AND {bind(b)}" for a, b in ranges if not (is_nan(a) or is_nan(b))]
            return "(" + (" OR ".join(parts) or "FALSE") + ")"
        if isinstance(e, Contains):
            return f"contains({x}, {bind(leaves.needle(e))})"
        p = leaves.pattern(e)
        if regexes.overflows(p):
            raise UnsupportedSqlExprError(f"{p!r} runs in Python, so it has no SQL text")
        subject = f"decode(encode({x}, 'UTF-8'), 'ISO-8859-1')" if regexes.wants_bytes(p) else x
        return f"{subject} RLIKE {bind(regexes.for_jvm(p))}"

    def text(e: Expr, under_not: bool) -> str:
        if isinstance(e, Not):
            return f"NOT ({text(e.operand, True)})"
        if isinstance(e, And | Or):
            return f"({text(e.left, under_not)} {'AND' if isinstance(e, And) else 'OR'} {text(e.right, under_not)})"
        if not isinstance(e, Comparison | Presence | Membership | Contains | Matches):
            raise leaves.unknown(e)
        x = resolve(e.field)
        if isinstance(e, Presence):
            return f"size(coalesce({x}, array())) > 0" if e.field.multi else f"{x} IS NOT NULL"
        out = f"exists({x}, x -> {one(e, 'x')})" if e.field.multi else one(e, x)
        return f"coalesce({out}, FALSE)" if under_not else out

    return text(e, False), args
