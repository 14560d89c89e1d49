"""What a workspace knows of itself: one JSON text a version, immutable once it is current."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyarrow import fs as pafs

from wirelake.binding import column_name
from wirelake.errors import SchemaVersionError
from wirelake.expr import FieldRef
from wirelake.ftypes import column_type
from wirelake.sources.pcap import filesystem

LAYOUT = 2
KEY_FIELDS = ("frame.number", "frame.time", "frame.time_epoch")
_PROBE = 65_536


@dataclass(frozen=True)
class FieldRecord:
    abbrev: str
    column_name: str
    ftype: str
    multi: bool
    column_type: str
    materialized_at: str

    @property
    def ref(self) -> FieldRef:
        return FieldRef(self.abbrev, self.ftype, self.multi)


def field_record(ref: FieldRef, at: str) -> FieldRecord:
    return FieldRecord(ref.name, column_name(ref.name), ref.ftype, ref.multi, column_type(ref.ftype, ref.multi).simpleString(), at)


@dataclass(frozen=True)
class CacheKey:
    key: str
    capture: str
    fingerprint: str
    fields: tuple[str, ...]
    display: str | None
    version: str
    argv: tuple[str, ...]
    created_at: str


def now() -> str:
    return datetime.now(UTC).isoformat()


def fingerprint(path: str) -> str:
    """Size, time of change and a digest of both ends of a capture (a folder: of its files). A change in the middle that keeps both isn't seen."""
    at, local = filesystem(path)
    info = at.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return _probe(at, info)
    parts = [f"{i.base_name}={_probe(at, i)}" for i in sorted(at.get_file_info(pafs.FileSelector(local)), key=lambda i: i.base_name) if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))]
    return "dir1:" + hashlib.sha256("\0".join(parts).encode("utf-8", "surrogateescape")).hexdigest()


def _probe(at: pafs.FileSystem, info: pafs.FileInfo) -> str:
    with at.open_input_file(info.path) as f:
        ends = [f.read(min(_PROBE, info.size)), b""]
        if info.size > _PROBE:
            f.seek(info.size - _PROBE)
            ends[1] = f.read(_PROBE)
    h = hashlib.sha256()
    for e in ends:
        h.update(b"%d:" % len(e) + e)
    return f"file1:{info.size}:{info.mtime_ns}:{h.hexdigest()}"


def cache_key(capture: str, fields: Sequence[str], display: str | None, version: str, argv: Sequence[str], print_: str | None = None, at: str | None = None) -> CacheKey:
    """The identity of a materialization. No two component lists have one digest: it is taken of their JSON, where None isn't ""."""
    if any(isinstance(x, str) for x in (argv, fields)):
        raise TypeError("lists of text are wanted, not text")
    names = tuple(sorted(set(fields)))
    print_ = print_ or fingerprint(capture)
    for t in (capture, *names, version, *argv, display or ""):
        t.encode("utf-8")  # what isn't UTF-8 can't be stored
    digest = hashlib.sha256(json.dumps([print_, names, display, version, list(argv)]).encode()).hexdigest()
    return CacheKey(f"key1:{digest}", capture, print_, names, display, version, tuple(argv), at or now())


def residue(argv: Sequence[str]) -> tuple[str, ...]:
    """A command without capture, filter and fields, which are compared on their own."""
    out, skip = [], False
    for a in argv:
        if skip or a in ("-r", "-Y", "-e"):
            skip = not skip
        else:
            out.append(a)
    return tuple(out)


@dataclass(frozen=True)
class Catalog:
    """``tables`` maps table names to folders of Parquet; a table that was never written has none."""

    layout: int = LAYOUT
    number: int = 0
    fields: tuple[FieldRecord, ...] = ()
    keys: tuple[CacheKey, ...] = ()
    tables: dict[str, str] = field(default_factory=dict)
    next_annotation: int | None = None

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def load(text: str) -> Catalog:
        x = json.loads(text)
        if x.get("layout") != LAYOUT:
            raise SchemaVersionError(f"the workspace has layout {x.get('layout')}, this engine reads and writes {LAYOUT}")
        x["fields"] = tuple(FieldRecord(**f) for f in x["fields"])
        x["keys"] = tuple(CacheKey(**{**k, "fields": tuple(k["fields"]), "argv": tuple(k["argv"])}) for k in x["keys"])
        return Catalog(**x)

    def with_(self, **changes) -> Catalog:
        return replace(self, **changes)

    def field(self, abbrev: str) -> FieldRecord | None:
        return next((f for f in self.fields if f.abbrev == abbrev), None)


def covering(keys: Sequence[CacheKey], print_: str, display: str | None, version: str, fields: Sequence[str]) -> CacheKey | None:
    """The newest key of the same capture, filter and version that has all of ``fields``."""
    fits = [k for k in keys if (k.fingerprint, k.display, k.version) == (print_, display, version) and set(fields) <= set(k.fields)]
    return max(fits, key=lambda k: (k.created_at, k.key), default=None)
