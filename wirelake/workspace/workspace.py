"""A workspace is a folder: Parquet tables, and catalogs of which one is current.

A change writes new tables and a new catalog and then renames the pointer ``CURRENT`` to it. Readers have one version from start to
end without locks; a change that fails leaves nothing behind. One writer at a time holds ``LOCK``.
"""

from __future__ import annotations

import copy
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.binding import Binding, Query, collisions
from wirelake.errors import ColumnNameCollisionError, MaterializationMismatchError, MissingStreamFieldsError, WorkspaceAliasError, WorkspaceError, WorkspaceModeError
from wirelake.expr import Expr, FieldRef
from wirelake.ftypes import decode, field_type, interval_text, ipv6_decimal, ipv6_decimals, naive_utc, occurrences
from wirelake.operators import annotations as notes
from wirelake.operators import keysets
from wirelake.operators.rollup import PROTOCOLS, REQUIRED, first_occurrence, streams
from wirelake.plans.display import compile_display
from wirelake.sources.capture import BuiltIn, Dissecting
from wirelake.workspace.catalog import KEY_FIELDS, CacheKey, Catalog, FieldRecord, cache_key, covering, field_record, fingerprint, now, residue
from wirelake.workspace.files import Files

TABLES = ("pkts", "streams", "annotations")
_NUMBER = FieldRef("frame.number", "FT_FRAMENUM")
_TIME = FieldRef("frame.time_epoch", "FT_ABSOLUTE_TIME")
_KEY = (("frame_number", "bigint"), ("frame_time", "timestamp_ntz"))
_STREAMS = "protocol string, stream_id long, src_addr long, src_port int, dst_addr long, dst_port int, first_frame long, last_frame long, pkt_count long, byte_count long, first_time timestamp_ntz, last_time timestamp_ntz"
_ALIAS = re.compile(r"(?!\d)\w+", re.ASCII)
_RESERVED = ("main", "temp", "system")


@dataclass(frozen=True)
class MaterializeResult:
    """``outcome``: materialized, hit or backfilled; ``batch_count``: the batches written, one for each task that wrote rows."""

    outcome: str
    row_count: int
    cache_key: CacheKey
    display: str | None
    fields: tuple[FieldRecord, ...]
    added_fields: tuple[FieldRecord, ...]
    batch_count: int = 0


@dataclass(frozen=True)
class StreamsResult:
    tcp_streams: int
    udp_streams: int

    @property
    def total(self) -> int:
        return self.tcp_streams + self.udp_streams


@dataclass(frozen=True)
class Annotation:
    annotation_id: int
    scope: str
    target_id: int
    key: str
    value: str | None
    created_at: datetime
    orphaned: bool
    protocol: str | None


class Workspace:
    """``mode`` "ro" reads, "rw" also writes and makes the workspace if the folder is empty or missing."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "ro"):
        if mode not in ("ro", "rw"):
            raise ValueError(f"mode is ro or rw, not {mode!r}")
        self.spark, self.path, self.mode = spark, os.fspath(path), mode
        self.files = Files(spark, self.path)
        self.attached: dict[str, Workspace] = {}
        self._busy = False
        self._held: Catalog | None = None
        self._read: tuple[str, Catalog] | None = None
        self._frames: dict[tuple[str, str, str], DataFrame] = {}
        if not self.files.exists("CURRENT"):
            if [n for n in self.files.names() if n != "LOCK"]:
                raise WorkspaceError(f"{self.path} holds other files and is no workspace")
            if mode == "ro":
                raise WorkspaceError(f"there is no workspace at {self.path}")
            self.files.make()
            with self.write() as change:
                change.catalog = Catalog()
        self.catalog  # refuses another layout

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.attached.clear()

    @property
    def catalog(self) -> Catalog:
        """The current version's, or the one that ``read`` holds; a version's text doesn't change, so it is read once."""
        if self._held is not None:
            return self._held
        name = self.files.read("CURRENT").strip()
        if self._read is None or self._read[0] != name:
            self._read = name, Catalog.load(self.files.read(name))
        return self._read[1]

    @contextmanager
    def read(self) -> Iterator[Workspace]:
        """The workspace at its current version: what others write meanwhile isn't seen, in however many queries."""
        held = copy.copy(self)
        held._held, held.mode = self.catalog, "ro"
        yield held

    @contextmanager
    def write(self) -> Iterator[_Change]:
        """A change of the workspace: all of it is published at the end, or nothing if it fails."""
        if self.mode != "rw":
            raise WorkspaceModeError(f"{self.path} is open for reading")
        if self._busy or not self.files.create("LOCK", f"{os.getpid()} {now()}"):
            raise WorkspaceError(f"{self.path} is being written; if no writer is left, delete LOCK")
        self._busy = True
        change = _Change(self, self.catalog if self.files.exists("CURRENT") else Catalog())
        try:
            before = change.catalog
            yield change
            if change.catalog is not before or not self.files.exists("CURRENT"):
                number = before.number + 1
                name = f"catalog-{number:08d}.json"
                self.files.delete(name)
                self.files.create(name, change.catalog.with_(number=number).dump())
                self.files.replace("CURRENT", name)
        except BaseException:
            for folder in change.made:
                self.files.delete(folder)
            raise
        finally:
            self._busy = False
            self.files.delete("LOCK")

    # tables

    def table(self, name: str, catalog: Catalog | None = None) -> DataFrame:
        """A table of one version, with its declared schema whether or not it was ever written."""
        c = catalog or self.catalog
        schema = {"pkts": _pkts_schema(c), "streams": T._parse_datatype_string(_STREAMS), "annotations": T._parse_datatype_string(notes.SCHEMA)}[name]
        if name not in c.tables:
            return self.spark.createDataFrame([], schema)
        at = (name, c.tables[name], schema.json())
        if at not in self._frames:
            self._frames[at] = self.spark.read.schema(schema).parquet(f"{self.files.root}/{c.tables[name]}")
        return self._frames[at]

    def query(self, alias: str | None = None, strict_portable: bool = False) -> Query:
        """A query over the packets, of an attached workspace if ``alias`` is given."""
        if alias is not None:
            self._attached(alias)

        def bind() -> Binding:
            at = self if alias is None else self._attached(alias)
            c = at.catalog
            return Binding(at.table("pkts", c), "frame_number", "frame_time", {f.abbrev: (f.ref, f"`{f.column_name}`") for f in c.fields}, "pkts" if alias is None else f"{alias}__pkts")

        return Query(bind, strict_portable=strict_portable)

    def sql(self, text: str, args: Sequence | None = None) -> DataFrame:
        """Any Spark SQL over ``pkts``, ``streams``, ``annotations`` and, of attached workspaces, ``<alias>__pkts`` and so on."""
        for prefix, ws in [("", self), *((f"{a}__", w) for a, w in self.attached.items())]:
            c = ws.catalog
            for t in TABLES:
                ws.table(t, c).createOrReplaceTempView(prefix + t)
        return self.spark.sql(text, args=list(args)) if args else self.spark.sql(text)

    # materialization

    def materialize(self, capture: str, fields: Sequence[FieldRef] = (), filter: Expr | None = None, dissector: Dissecting | None = None) -> MaterializeResult:
        """Dissect ``capture`` once into columns: a first time, not at all if the columns are there, or only the new fields."""
        dissector = dissector or BuiltIn()
        with self.write() as change:
            asked = {r.name: r for r in reversed(fields)}
            new = {n: r for n, r in sorted(asked.items()) if n not in KEY_FIELDS}
            c = change.catalog
            shared = collisions([*(f.abbrev for f in c.fields), *new])
            if shared:
                raise ColumnNameCollisionError("; ".join(f"{k} would hold {', '.join(v)}" for k, v in sorted(shared.items())))
            display = compile_display(filter) if filter is not None else None
            pushed = [] if filter is None else [filter]
            if not c.keys:
                return self._fresh(change, capture, asked, new, display, pushed, dissector)
            if len(c.keys) > 1:
                raise WorkspaceError(f"{len(c.keys)} cache keys: a workspace has one materialization")
            return self._again(change, capture, asked, new, display, pushed, dissector)

    def _fresh(self, change, capture, asked, new, display, pushed, dissector) -> MaterializeResult:
        c = change.catalog
        rows = self.table("pkts", c).count()
        if rows or c.fields:
            raise WorkspaceError(f"{rows} rows and {len(c.fields)} fields without a cache key: something else wrote them")
        refs = [_NUMBER, _TIME, *new.values()]
        key = cache_key(capture, list(asked), display, dissector.version(), dissector.command(capture, display, refs))
        records = tuple(field_record(r, key.created_at) for r in new.values())
        raw = dissector.scan(self.spark, capture, display, pushed, refs)
        df = raw.select(_stored(_NUMBER, "frame_number"), _stored(_TIME, "frame_time"), *[_stored(r, f.column_name) for r, f in zip(new.values(), records)])
        change.put("pkts", df)
        change.catalog = change.catalog.with_(fields=records, keys=(key,))
        return MaterializeResult("materialized", self.table("pkts", change.catalog).count(), key, display, records, records, change.batches("pkts"))

    def _again(self, change, capture, asked, new, display, pushed, dissector) -> MaterializeResult:
        c = change.catalog
        old = c.keys[0]
        self._sound(c, old)
        redeclared = [f"{n}: {f.ftype}{'[]' * f.multi}, not {r.ftype}{'[]' * r.multi}" for n, r in new.items() if (f := c.field(n)) and (f.ftype, f.multi) != (r.ftype, r.multi)]
        if redeclared:
            raise MaterializationMismatchError("declared otherwise: " + "; ".join(redeclared))
        refs = {f.abbrev: f.ref for f in c.fields} | {n: r for n, r in new.items() if not c.field(n)}
        every = [_NUMBER, _TIME, *(refs[n] for n in sorted(refs))]
        argv = dissector.command(capture, display, every)
        now_print, version = fingerprint(capture), dissector.version()
        pairs = (("capture", old.fingerprint, now_print), ("filter", old.display, display), ("dissector's version", old.version, version), ("dissector's arguments", residue(old.argv), residue(argv)))
        if changed := [f"{what} (stored {str(a)[:160]}, asked {str(b)[:160]})" for what, a, b in pairs if a != b]:
            raise MaterializationMismatchError("another materialization is stored: " + "; ".join(changed))
        if hit := covering(c.keys, now_print, display, version, list(asked)):
            return MaterializeResult("hit", 0, hit, display, c.fields, ())
        key = cache_key(capture, [*old.fields, *asked], display, version, argv, now_print)
        added = [r for n, r in new.items() if not c.field(n)]
        if not added:
            change.catalog = c.with_(keys=(key,))
            return MaterializeResult("hit", 0, key, display, c.fields, ())
        pkts = self.table("pkts", c)
        twice = [r[0] for r in keysets.duplicates(pkts, "frame_number", 5).collect()]
        nulls = pkts.filter("frame_number IS NULL").count()
        if twice or nulls:
            raise WorkspaceError(f"rows can't be matched: frame numbers of several rows {twice}, rows without one {nulls}")
        records = tuple(field_record(r, key.created_at) for r in added)
        raw = dissector.scan(self.spark, capture, display, pushed, [_NUMBER, *added])
        scan = change.stage(raw.select(_stored(_NUMBER, "frame_number"), *[_stored(r, f.column_name) for r, f in zip(added, records)]))
        if d := keysets.drift(scan, pkts, "frame_number"):
            raise WorkspaceError(f"the capture no longer gives the stored rows: {d}")
        change.put("pkts", pkts.join(scan, "frame_number", "left").select(*pkts.columns, *[f.column_name for f in records]))
        everything = tuple(sorted((*c.fields, *records), key=lambda f: f.abbrev))
        change.catalog = change.catalog.with_(fields=everything, keys=(key,))
        return MaterializeResult("backfilled", scan.count(), key, display, everything, records, change.batches("pkts"))

    def _sound(self, c: Catalog, key: CacheKey) -> None:
        claimed, known = {n for n in key.fields if n not in KEY_FIELDS}, {f.abbrev for f in c.fields}
        if claimed != known:
            raise WorkspaceError(f"catalog at odds: only in the cache key {sorted(claimed - known)}, only in the registry {sorted(known - claimed)}")
        if "pkts" not in c.tables:
            raise WorkspaceError("the packets' table is missing")
        found = dict(self.spark.read.parquet(f"{self.files.root}/{c.tables['pkts']}").dtypes)
        want = dict(_KEY) | {f.column_name: f.column_type for f in c.fields}
        if bad := [f"{n} is {found.get(n, 'missing')}, not {t}" for n, t in want.items() if found.get(n) != t]:
            raise WorkspaceError("the packets' table doesn't fit the catalog: " + "; ".join(bad))

    # streams

    def build_streams(self) -> StreamsResult:
        """Roll the packets up into conversations; built anew each time."""
        with self.write() as change:
            c = change.catalog
            if missing := tuple(n for n in REQUIRED if not c.field(n)):
                raise MissingStreamFieldsError(missing)
            value = lambda f: first_occurrence(F.col(f.column_name)) if f.multi else F.col(f.column_name)
            change.put("streams", streams(self.table("pkts", c), {n: value(c.field(n)) for n in REQUIRED}))
            n = {r["protocol"]: r["count"] for r in self.table("streams", change.catalog).groupBy("protocol").count().collect()}
            return StreamsResult(*[n.get(p, 0) for p in PROTOCOLS])

    # annotations

    def add_annotation(self, scope: str, target_id: int, key: str, value: str | None = None, *, protocol: str | None = None, created_at: datetime | None = None) -> int:
        """The finding's number; numbers are never used again."""
        return self.add_annotations([(scope, target_id, key, value, protocol, created_at)])[0]

    def add_annotations(self, rows: Sequence[tuple]) -> list[int]:
        """Many findings (scope, target_id, key, value, protocol, created_at) in one change."""
        for scope, _, key, _, protocol, _ in rows:
            if scope not in notes.SCOPES:
                raise ValueError(f"{scope!r} isn't one of {notes.SCOPES}")
            if scope == "stream" and protocol not in PROTOCOLS:
                raise ValueError(f"a stream's number needs its protocol, one of {PROTOCOLS}")
            if scope == "packet" and protocol is not None:
                raise ValueError("a packet has no protocol besides its number")
            if not key:
                raise ValueError("a finding needs a key")
        with self.write() as change:
            old, start = self._annotated(change)
            stamp = lambda t: naive_utc(t or datetime.now(UTC))
            new = [(start + i, scope, target, protocol, key, value, stamp(at)) for i, (scope, target, key, value, protocol, at) in enumerate(rows)]
            change.put("annotations", old.unionByName(self.spark.createDataFrame(new, notes.SCHEMA)))
            change.catalog = change.catalog.with_(next_annotation=start + len(new))
            return [r[0] for r in new]

    def add_annotation_rows(self, rows: DataFrame, order: Sequence[str]) -> int:
        """As many findings as a table (scope, target_id, key, value, protocol, created_at) has, in one change, numbered in the order of the
        columns ``order``. The table stays where it is: the driver gets a count of each sorted part. Gives the number of findings."""
        stream = F.col("scope").eqNullSafe("stream")
        known = F.coalesce(F.col("protocol").isin(*PROTOCOLS), F.lit(False))
        bad = ~F.col("scope").eqNullSafe("packet") & ~stream | stream & ~known | ~stream & F.col("protocol").isNotNull() | (F.coalesce("key", F.lit("")) == "") | F.col("target_id").isNull()
        if found := rows.filter(bad).select("scope", "target_id", "key", "protocol").take(1):
            raise ValueError(f"no finding: {found[0]}")
        with self.write() as change:
            old, start = self._annotated(change)
            names = T._parse_datatype_string(notes.SCHEMA).names
            stamped = rows.withColumn("created_at", F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit(naive_utc(datetime.now(UTC)).isoformat(sep=" ")).cast("timestamp_ntz")))
            new, n = keysets.numbered(stamped, order, "annotation_id", start, change.stage)
            change.put("annotations", old.unionByName(new.select(*names)))
            change.catalog = change.catalog.with_(next_annotation=start + n)
            return n

    def _annotated(self, change: _Change) -> tuple[DataFrame, int]:
        """The findings so far and the next one's number."""
        old, start = self.table("annotations", change.catalog), change.catalog.next_annotation
        if start is None:
            if not old.isEmpty():
                raise WorkspaceError("findings without the mark of the next number: numbers that were used can't be told")
            start = 1
        return old, start

    def annotations(self) -> DataFrame:
        """All findings with the flag ``orphaned``."""
        c = self.catalog
        return notes.orphaned(self.table("annotations", c), self.table("pkts", c), self.table("streams", c))

    def found_annotations(self, *, scope: str | None = None, target_id: int | None = None, key: str | None = None, protocol: str | None = None) -> DataFrame:
        """The findings that meet all criteria that are given, with the flag ``orphaned``."""
        return self.annotations().filter(notes.selected(scope, target_id, key, protocol))

    def list_annotations(self, *, scope: str | None = None, target_id: int | None = None, key: str | None = None, protocol: str | None = None) -> tuple[Annotation, ...]:
        df = self.found_annotations(scope=scope, target_id=target_id, key=key, protocol=protocol).orderBy("annotation_id")
        return tuple(Annotation(r["annotation_id"], r["scope"], r["target_id"], r["key"], r["value"], decode("FT_ABSOLUTE_TIME", r["created_at"]), r["orphaned"], r["protocol"]) for r in df.collect())

    def remove_annotation(self, annotation_id: int) -> bool:
        return self._remove(lambda a: a.filter(F.col("annotation_id") == annotation_id)) > 0

    def remove_annotations(self, *, scope: str | None = None, target_id: int | None = None, key: str | None = None, protocol: str | None = None) -> int:
        if (scope, target_id, key, protocol) == (None,) * 4:
            raise ValueError("say which findings to remove")
        return self._remove(lambda a: a.filter(notes.selected(scope, target_id, key, protocol)))

    def delete_orphan_annotations(self) -> int:
        return self._remove(lambda a: a.filter("orphaned"))

    def _remove(self, which) -> int:
        with self.write() as change:
            gone = which(self.annotations()).select("annotation_id")
            if n := gone.count():
                change.put("annotations", self.table("annotations", change.catalog).join(gone, "annotation_id", "left_anti").select(*T._parse_datatype_string(notes.SCHEMA).names))
            return n

    # other workspaces

    def attach(self, path: str, alias: str) -> None:
        """Make another workspace's tables readable under ``alias``."""
        if not _ALIAS.fullmatch(alias):
            raise WorkspaceAliasError(f"{alias!r}: a name has letters, digits and _ and no digit first")
        if alias.lower() in (*_RESERVED, *TABLES) or alias.lower() in (a.lower() for a in self.attached):
            raise WorkspaceAliasError(f"{alias!r} is taken")
        if self.files.same(os.fspath(path)):
            raise WorkspaceAliasError("a workspace isn't attached to itself")
        self.attached[alias] = Workspace(self.spark, path)

    def detach(self, alias: str) -> None:
        self._attached(alias)
        del self.attached[alias]

    @property
    def attachments(self) -> dict[str, str]:
        return {a: w.path for a, w in self.attached.items()}

    def _attached(self, alias: str) -> Workspace:
        if alias not in self.attached:
            raise WorkspaceAliasError(f"nothing is attached as {alias!r}")
        return self.attached[alias]

    # export, compaction

    def export_parquet(self, table: str, path: str, single_file: bool = False) -> str:
        """A table as Parquet that any engine reads: IPv6 addresses as decimal text, intervals as text.

        A folder of as many files as tasks write, or with ``single_file`` one file, which one task writes. What was there under ``path``
        stays until the new export is whole: a file is replaced at once; a folder is put aside, and deleted when the new one has its name.
        """
        if table not in TABLES:
            raise ValueError(f"{table!r} isn't one of {TABLES}")
        path = os.fspath(path)
        if self.files.same(path):
            raise WorkspaceError("an export doesn't go into the workspace")
        c = self.catalog
        df = _portable(self.table(table, c), {f.column_name: f for f in c.fields} if table == "pkts" else {})
        folder, _, name = path.rpartition("/")
        out = Files(self.spark, folder or ".")
        passing, aside = f".{name}-{uuid.uuid4().hex}", f".{name}-old-{uuid.uuid4().hex}"
        try:
            (df.coalesce(1) if single_file else df).write.parquet(f"{out.root}/{passing}")
            made = Files(self.spark, f"{out.root}/{passing}")
            new = f"{passing}/{next(n for n in made.names() if n.endswith('.parquet'))}" if single_file else passing
            if single_file and out.exists(name) and not out.is_folder(name):
                out.put_over(new, name)
            elif out.exists(name):
                out.rename(name, aside)
                try:
                    out.rename(new, name)
                except BaseException:
                    out.rename(aside, name)
                    raise
                out.delete(aside)
            else:
                out.rename(new, name)
        finally:
            out.delete(passing)
            out.delete(f".{name}.crc")  # local file systems' checksums
        return path

    def compact(self, rows_per_file: int = 5_000_000, keep: timedelta = timedelta(days=1)) -> None:
        """Rewrite the tables into full files, the packets sorted by frame number, and delete versions that are no longer read.

        Versions stay for ``keep`` after another took their place, so readers that began before have their files until then.
        """
        with self.write() as change:
            for t in list(change.catalog.tables):
                df = self.table(t, change.catalog)
                if t == "pkts":
                    df = df.repartitionByRange(max(1, -(-df.count() // rows_per_file)), "frame_number").sortWithinPartitions("frame_number")
                else:
                    df = df.coalesce(max(1, -(-df.count() // rows_per_file)))
                change.put(t, df)
        self._frames.clear()
        names = self.files.names()
        current = self.files.read("CURRENT").strip()
        catalogs = [n for n in names if re.fullmatch(r"catalog-\d+\.json", n)]
        until = datetime.now(UTC).timestamp() - keep.total_seconds()
        stay = {n for n, after in zip(catalogs, [*catalogs[1:], None]) if n == current or after is None or self.files.changed(after) > until}
        used = {folder for n in stay for folder in Catalog.load(self.files.read(n)).tables.values()}
        for n in names:
            if n not in stay | used and re.fullmatch(r"catalog-\d+\.json|(?:pkts|streams|annotations|stage)-[0-9a-f]+", n):
                self.files.delete(n)


class _Change:
    """Tables that are written under new names, and the catalog that is to name them."""

    def __init__(self, ws: Workspace, catalog: Catalog):
        self.ws, self.catalog, self.made = ws, catalog, []

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        self.made.append(folder)
        df.write.parquet(f"{self.ws.files.root}/{folder}")
        return folder

    def put(self, table: str, df: DataFrame) -> None:
        self.catalog = self.catalog.with_(tables=self.catalog.tables | {table: self._write(df, table)})

    def batches(self, table: str) -> int:
        """The files that a table of this change has."""
        return sum(n.endswith(".parquet") for n in Files(self.ws.spark, f"{self.ws.files.root}/{self.catalog.tables[table]}").names())

    def sql(self, text: str, args: Sequence | None = None) -> DataFrame:
        """Spark SQL over the tables as this change has them so far; ``put`` writes what it gives."""
        for t in TABLES:
            self.ws.table(t, self.catalog).createOrReplaceTempView(t)
        return self.ws.spark.sql(text, args=list(args)) if args else self.ws.spark.sql(text)

    def stage(self, df: DataFrame) -> DataFrame:
        """Written once, so a dissector runs once."""
        return self.ws.spark.read.schema(df.schema).parquet(f"{self.ws.files.root}/{self._write(df, 'stage')}")


def _pkts_schema(c: Catalog) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in (*_KEY, *((f.column_name, f.column_type) for f in c.fields))))


def _stored(ref: FieldRef, name: str):
    return occurrences(F.col(f"`{ref.name}`"), ref.ftype, ref.multi, ref.name).alias(name)


def _portable(df: DataFrame, records: dict[str, FieldRecord]) -> DataFrame:
    out = []
    for name, f in ((n, records.get(n)) for n in df.columns):
        c = F.col(f"`{name}`")
        if f and f.ftype == "FT_IPv6":
            c = (ipv6_decimals if f.multi else ipv6_decimal)(c)
        elif f and isinstance(field_type(f.ftype).spark, T.DayTimeIntervalType):
            c = F.transform(c, interval_text) if f.multi else F.when(c.isNotNull(), interval_text(c))
        out.append(c.alias(name))
    return df.select(*out)
