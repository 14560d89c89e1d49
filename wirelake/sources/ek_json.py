"""Dissected packets as JSON lines: index lines alternate with ``{"timestamp": ..., "layers": {...}}``."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelake.expr import FieldRef


def raw_values(value: object) -> list[str] | None:
    """Raw occurrences of a JSON value; None for an object, which holds other fields but is no value."""
    if isinstance(value, dict):
        return None
    if isinstance(value, list):
        return [t for v in value for t in raw_values(v) or []]
    if value is None:
        return []
    return [str(int(value)) if isinstance(value, bool) else value if isinstance(value, str) else json.dumps(value)]


def _named(tree: object, keys: tuple[str, ...], suffix: bool) -> list[str] | None:
    """The first value in depth-first order under one of ``keys`` (or a key that ends with one)."""
    if not isinstance(tree, dict):
        return next((v for x in tree if (v := _named(x, keys, suffix)) is not None), None) if isinstance(tree, list) else None
    for k, v in tree.items():
        if k in keys or suffix and k.endswith(keys):
            if (out := raw_values(v)) is not None:
                return out
        if isinstance(v, dict | list) and (out := _named(v, keys, suffix)) is not None:
            return out
    return None


def look_up(layers: dict, name: str) -> list[str]:
    """A field's raw occurrences: in the layer it is named after, and failing that under any layer."""
    flat = name.replace(".", "_")
    layer = name.partition(".")[0]
    found = None
    if layer in layers:
        found = _named(layers[layer], (f"{layer}_{flat}", flat), False)
    if found is None:
        found = _named(layers, (f"_{flat}",), True)
    return found or []


def layers_of(line: str) -> dict | None:
    """None for blank and index lines; ValueError for what isn't a packet."""
    if not line.strip():
        return None
    try:
        x = json.loads(line)
    except ValueError as e:
        raise ValueError(f"not JSON: {line[:200]!r}") from e
    if not isinstance(x, dict) or "layers" not in x:
        if isinstance(x, dict) and "index" in x:
            return None
        raise ValueError(f"no packet: {line[:200]!r}")
    if not isinstance(x["layers"], dict):
        raise ValueError(f"layers isn't an object: {line[:200]!r}")
    return x["layers"]


def raw_fields(lines: DataFrame, refs: Sequence[FieldRef], column: str = "value") -> DataFrame:
    names = [r.name for r in refs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packets = [x for t in b.column(0).to_pylist() if t is not None and (x := layers_of(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([look_up(p, n) for p in packets], pa.list_(pa.string())) for n in names], names)

    return lines.select(F.col(f"`{column}`")).mapInArrow(run, ", ".join(f"`{n}` array<string>" for n in names))


def read_ek_json(spark: SparkSession, path: str | list[str], refs: Sequence[FieldRef]) -> DataFrame:
    return raw_fields(spark.read.option("lineSep", "\n").text(path), refs)


__all__ = ["layers_of", "look_up", "pd", "raw_fields", "raw_values", "read_ek_json"]
