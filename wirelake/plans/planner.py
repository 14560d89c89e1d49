"""Splits a query's terms into what the dissector filters, what is filtered afterwards, and what has to be read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from wirelake.errors import UnsupportedExprError
from wirelake.expr import Expr, FieldRef, conjuncts, field_refs
from wirelake.plans.display import compile_display


@dataclass(frozen=True, eq=False)
class Plan:
    """``display``: filter for the dissector; ``mode``: "fields" reads ``projection`` only, "ek" everything; ``residual``: expressions, then opaque predicates."""

    display: str | None
    pushed: tuple[Expr, ...]
    mode: str
    projection: tuple[FieldRef, ...] | None
    residual: tuple[Expr, ...]
    opaque: tuple[Callable, ...]

    def explain(self) -> str:
        n = len(self.residual) + len(self.opaque)
        read = "everything" if self.projection is None else ", ".join(f.name for f in self.projection) or "nothing"
        return f"mode: {self.mode}\npushed filter: {self.display or 'none'}\nread: {read}\nfiltered afterwards: {n or 'nothing'}{' terms' if n else ''}"


def make_plan(terms: Sequence[Expr | Callable], select: Sequence[FieldRef] | None = None) -> Plan:
    """Conjuncts with a display filter are pushed, other expressions and then callables filter afterwards.

    Callables may look at any field, so with one, or without a selection, everything is read; fields of pushed conjuncts aren't read for that.
    """
    pushed: list[tuple[str, Expr]] = []
    residual: list[Expr] = []
    opaque: list[Callable] = []
    for t in terms:
        if isinstance(t, Expr):
            for c in conjuncts(t):
                try:
                    pushed.append((compile_display(c), c))
                except UnsupportedExprError:
                    residual.append(c)
        elif callable(t):
            opaque.append(t)
        else:
            raise TypeError(f"a query's terms are expressions or predicates, not {type(t).__name__}")
    display = " && ".join(f"({text})" for text, _ in pushed) or None
    read = None
    if select is not None and not opaque:
        first: dict[str, FieldRef] = {}
        for f in [*select, *(f for e in residual for f in field_refs(e))]:
            first.setdefault(f.name, f)
        read = tuple(first.values())
    return Plan(display, tuple(e for _, e in pushed), "ek" if read is None else "fields", read, tuple(residual), tuple(opaque))
