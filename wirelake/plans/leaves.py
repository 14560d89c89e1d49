"""What all back ends check of a leaf: coerced values, ordered ranges, kinds of fields."""

from __future__ import annotations

from wirelake.expr import Contains, Expr, FieldRef, Matches, Membership, ValueRange
from wirelake.ftypes import coerce, field_type


def members(e: Membership) -> tuple[list, list[tuple]]:
    """Coerced single values and ranges."""
    single, ranges = [], []
    for v in e.values:
        if isinstance(v, ValueRange):
            lo, hi = coerce(e.field.ftype, v.lo), coerce(e.field.ftype, v.hi)
            if hi < lo:
                raise ValueError(f"{e.field.name}: the range {v.lo!r} to {v.hi!r} ends before it starts")
            ranges.append((lo, hi))
        else:
            single.append(coerce(e.field.ftype, v))
    return single, ranges


def needle(e: Contains) -> str | bytes:
    want = field_type(e.field.ftype).python
    if want not in (str, bytes) or not isinstance(e.needle, want):
        raise TypeError(f"{e.field.name} ({e.field.ftype}) can't contain {type(e.needle).__name__}: text fields contain text, byte fields bytes")
    return e.needle


def pattern(e: Matches) -> str:
    if field_type(e.field.ftype).python is not str:
        raise TypeError(f"{e.field.name} ({e.field.ftype}) isn't text: matches is for text fields")
    return e.pattern


def unknown(e: object) -> TypeError:
    return TypeError(f"{type(e).__name__} isn't an expression")


__all__ = ["Expr", "FieldRef", "members", "needle", "pattern", "unknown"]
