"""A capture as a lazy query: each use dissects it anew. Dissectors turn a capture into raw columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.errors import FieldNotProjectedError
from wirelake.expr import Expr, FieldRef, field_refs
from wirelake.ftypes import field_type, occurrences
from wirelake.plans.columns import compile_column
from wirelake.plans.planner import Plan, make_plan
from wirelake.plans.predicate import compile_predicate
from wirelake.sources import ek_json, fields_text, process
from wirelake.sources.pcap import FIELDS, Dissector, check_fields, read_pcap
from wirelake.sources.program import run_program


class Dissecting(Protocol):
    """``version`` and ``command`` identify what a scan gives; ``scan`` gives an array<string> column for each field, named by it."""

    def version(self) -> str: ...

    def command(self, capture: str, display: str | None, refs: Sequence[FieldRef]) -> list[str]: ...

    def scan(self, spark: SparkSession, capture: str, display: str | None, pushed: Sequence[Expr], refs: Sequence[FieldRef]) -> DataFrame: ...


def with_values(raw: DataFrame, refs: Sequence[FieldRef]) -> DataFrame:
    """Typed columns, named by the field, of raw ones."""
    return raw.select(*[occurrences(F.col(f"`{r.name}`"), r.ftype, r.multi, r.name).alias(r.name) for r in refs])


def filter_raw(raw: DataFrame, terms: Sequence[Expr]) -> DataFrame:
    """Rows whose fields pass; a test sees all occurrences of a field, declared single or not."""
    for t in terms:
        raw = raw.filter(compile_column(_all_occurrences(t), lambda r: occurrences(F.col(f"`{r.name}`"), r.ftype, True, r.name)))
    return raw


def _all_occurrences(e: Expr) -> Expr:
    changed = {}
    for k in e.__dataclass_fields__:
        x = getattr(e, k)
        if isinstance(x, FieldRef):
            changed[k] = FieldRef(x.name, x.ftype, True)
        elif isinstance(x, Expr):
            changed[k] = _all_occurrences(x)
    return replace(e, **changed)


class RawPacket(dict):
    """Field names to raw occurrences, and a protocol to its typed values (``packet[TCP].port``); asking for a field that wasn't read is an error, not an absence."""

    def __missing__(self, name):
        if not isinstance(name, str) and callable(name):
            return name(self)
        raise FieldNotProjectedError(f"{name} wasn't read; a predicate names the fields it looks at with needs(...)")

    def get(self, name: str, default=()):
        return self[name] or default


class _WholePacket(RawPacket):
    """A packet of the built-in dissector, which dissects a layer once a field of it is asked for."""

    def __init__(self, found: dict[str, list[str]], dissector: Dissector):
        super().__init__((n, tuple(v)) for n, v in found.items())
        self._dissector, self._frame = dissector, dissector.frame

    def __missing__(self, name):
        if not isinstance(name, str) or name not in FIELDS:
            return super().__missing__(name)
        if not self._dissector.has(name):
            self.update((n, tuple(v)) for n, v in self._dissector.also(name, self._frame).items())
        return self.setdefault(name, ())


def _of_all(method: str) -> Callable:
    def over_all(self, *args):
        for n in FIELDS:
            self[n]
        return getattr(dict, method)(self, *args)

    return over_all


for _m in ("__contains__", "__iter__", "__len__", "__eq__", "__ne__", "__repr__", "__or__", "__ror__", "__reversed__", "keys", "values", "items", "copy"):
    setattr(_WholePacket, _m, _of_all(_m))


@dataclass(frozen=True)
class _Passes:
    """Whether a packet passes expressions and then predicates; these see ``names``, or the whole packet if there are none."""

    terms: tuple[Expr, ...]
    tests: tuple[Callable, ...]
    names: tuple[str, ...] | None

    def __call__(self, found: dict[str, list[str]], dissector: Dissector) -> bool:
        if not all(p(found) for p in self.compiled):
            return False
        packet = _WholePacket(found, dissector) if self.names is None else RawPacket((n, tuple(found.get(n, ()))) for n in self.names)
        return all(t(packet) for t in self.tests)

    @cached_property
    def compiled(self) -> list[Callable]:
        return [compile_predicate(e) for e in self.terms]


def needs(*fields: FieldRef) -> Callable[[Callable], Callable]:
    """Marks a predicate with the fields that it looks at: ``@needs(TCP.port)``."""

    def mark(predicate: Callable) -> Callable:
        predicate.reads = fields
        return predicate

    return mark


@dataclass(frozen=True)
class BuiltIn:
    """The dissector in Python of ``sources.pcap``; what would be pushed to a program is filtered in Spark.

    A folder's files are captures of their own, or, ``continued``, parts of one, in the order of their names.
    """

    continued: bool = False

    def version(self) -> str:
        from wirelake import __version__

        return f"wirelake {__version__}" + ", continued files" * self.continued

    def command(self, capture: str, display: str | None, refs: Sequence[FieldRef]) -> list[str]:
        return process.command("wirelake", capture, display, refs)

    def scan(self, spark: SparkSession, capture: str, display: str | None, pushed: Sequence[Expr], refs: Sequence[FieldRef]) -> DataFrame:
        names = list(dict.fromkeys([*(r.name for r in refs), *(f.name for e in pushed for f in field_refs(e))]))
        check_fields(names)
        return filter_raw(read_pcap(spark, capture, names, continued=self.continued), pushed).select(*[f"`{r.name}`" for r in refs])

    def passing(self, spark: SparkSession, capture: str, terms: Sequence[Expr], tests: Sequence[Callable], refs: Sequence[FieldRef]) -> DataFrame:
        """Raw columns ``refs`` of the packets that pass expressions and then predicates, which are tested where packets are dissected: what
        they look at doesn't leave the task, and a packet is dissected as far as they look."""
        named = [r.name for r in (*refs, *(f for e in terms for f in field_refs(e)))]
        whole = any(not hasattr(t, "reads") for t in tests)
        seen = None if whole else tuple(dict.fromkeys([*named, *(r.name for t in tests for r in t.reads)]))
        check_fields(seen or named)
        of_terms = tuple(dict.fromkeys(f.name for e in terms for f in field_refs(e)))
        return read_pcap(spark, capture, list(dict.fromkeys(r.name for r in refs)), continued=self.continued, wanted=seen if seen is not None else of_terms, whole=whole, test=_Passes(tuple(terms), tuple(tests), seen))


@dataclass(frozen=True)
class Program:
    """A dissector program, run by a task; it filters itself."""

    tool: str | None = None

    def version(self) -> str:
        return process.version(process.program(self.tool))

    def command(self, capture: str, display: str | None, refs: Sequence[FieldRef]) -> list[str]:
        return process.command(process.program(self.tool), capture, display, refs)

    def scan(self, spark: SparkSession, capture: str, display: str | None, pushed: Sequence[Expr], refs: Sequence[FieldRef]) -> DataFrame:
        return fields_text.raw_fields(run_program(spark, self.command(capture, display, refs)), refs)


@dataclass(frozen=True)
class Dumped:
    """Text that a dissector program printed before: lines of ``fields`` (in this order) or JSON lines if there are none."""

    path: str
    fields: tuple[FieldRef, ...] | None = None
    stated: str = "text"

    def version(self) -> str:
        return self.stated

    def command(self, capture: str, display: str | None, refs: Sequence[FieldRef]) -> list[str]:
        return process.command("dumped", capture, display, refs)

    def scan(self, spark: SparkSession, capture: str, display: str | None, pushed: Sequence[Expr], refs: Sequence[FieldRef]) -> DataFrame:
        if self.fields is None:
            asked = list({r.name: r for r in [*refs, *(f for e in pushed for f in field_refs(e))]}.values())
            raw = ek_json.read_ek_json(spark, self.path, asked)
        else:
            raw = fields_text.read_fields_text(spark, self.path, self.fields)
        return filter_raw(raw, pushed).select(*[f"`{r.name}`" for r in refs])


@dataclass(frozen=True)
class Capture:
    """``Capture(spark, path).filter(IP.ttl < 5).select(TCP.port)``; terms are expressions or predicates of a raw packet (dict)."""

    spark: SparkSession
    path: str
    dissector: Dissecting = BuiltIn()
    terms: tuple[Expr | Callable, ...] = ()

    def filter(self, *terms: Expr | Callable) -> Capture:
        return replace(self, terms=self.terms + terms)

    def plan(self, select: Sequence[FieldRef] | None = None) -> Plan:
        return make_plan(self.terms, select)

    def raw(self, select: Sequence[FieldRef]) -> DataFrame:
        """Raw columns of ``select`` after all terms.

        Predicates see these fields, those that the expressions name, and those of ``needs``; one without ``needs`` sees the whole packet, if
        the dissector is the built-in one, which tests predicates itself (``passing``).
        """
        plan = self.plan(select)
        if plan.opaque and hasattr(self.dissector, "passing"):
            terms = [e for e in self.terms if isinstance(e, Expr)]
            return self.dissector.passing(self.spark, self.path, terms, plan.opaque, select).select(*[f"`{r.name}`" for r in select])
        seen = [f for t in self.terms for f in (field_refs(t) if isinstance(t, Expr) else getattr(t, "reads", ()))] if plan.opaque else []
        refs = list({r.name: r for r in [*select, *(f for e in plan.residual for f in field_refs(e)), *seen]}.values())
        df = filter_raw(self.dissector.scan(self.spark, self.path, plan.display, plan.pushed, refs), plan.residual)
        if plan.opaque:
            names, tests = [r.name for r in refs], plan.opaque

            @F.pandas_udf("boolean")
            def passes(packets: pd.DataFrame) -> pd.Series:
                rows = zip(*(packets[n] for n in names))
                return pd.Series([all(t(RawPacket(zip(names, map(tuple, r)))) for t in tests) for r in rows], dtype=bool)

            df = df.filter(passes(F.struct(*[f"`{n}`" for n in names])))
        return df.select(*[f"`{r.name}`" for r in select])

    def select(self, *fields: FieldRef) -> DataFrame:
        """Typed columns, named by the field."""
        return with_values(self.raw(fields), fields)

    def packets(self, *fields: FieldRef) -> Iterator[RawPacket]:
        """Raw packets of these fields."""
        for row in self.raw(fields).toLocalIterator():
            yield RawPacket({r.name: tuple(row[r.name]) for r in fields})


def first(raw: Sequence[str], ref: FieldRef) -> object:
    """A single field's value in a raw packet: its first occurrence, None if absent."""
    return field_type(ref.ftype).parse(raw[0]) if raw else None
