"""WARC: a writer and a splittable reader of gzip members."""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelake.llm.common import delete_at_exit, only, scratch_path

MAGIC = b"\x1f\x8b\x08"
SCHEMA = "path string, offset long, number int, type string, record_id string, uri string, date string, content_type string, headers map<string,string>, payload binary"
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("number", pa.int32()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
_BLOCK = 1 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Of a qualified path; one without a scheme is the local file system's."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: that of the default file system, as Spark itself has it, if none is named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers and block of one decompressed record; None if it isn't a whole one."""
    if not data.startswith(b"WARC/"):
        return None
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        return None
    headers: dict[str, str] = {}
    last = ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in " \t" and last:
            headers[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        headers[last] = value.strip()
    try:
        n = int(headers["content-length"])
    except (KeyError, ValueError):
        return None
    return (headers, rest[:n]) if 0 <= n <= len(rest) else None


class _Window:
    """Forward reads of a file from any place."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        self.file.seek(at)
        return self.file.read(min(n, self.size - at))


def _parts(w: _Window, at: int, block: int) -> Iterator[tuple[bytes, int]]:
    """Pieces of the decompressed gzip member at ``at``; the last one, (b"", place after it), comes only if its checksum holds."""
    d = zlib.decompressobj(31)
    pos, most = at, 16  # a few bytes are enough to tell a record from chance
    while not d.eof:
        raw = d.unconsumed_tail
        if not raw:
            raw = w.read(pos, block)
            if not raw:
                return
            pos += len(raw)
        try:
            piece = d.decompress(raw, most)
        except zlib.error:
            return
        most = 4 * block
        if piece:
            yield piece, -1
    yield b"", pos - len(d.unused_data)


def _member(w: _Window, at: int, block: int) -> Iterator[tuple[int, dict[str, str], bytes] | int]:
    """(number, headers, block) of the records of the gzip member at ``at``, then the place after it.

    Ends early where the member isn't one, is damaged or holds something else than records. A record is returned once the next one begins
    or the member's checksum holds; so of a damaged member the records in the blocks before the damage are returned, and never all of it is held in memory.
    """
    data, number, held = bytearray(), 0, None
    for piece, after in _parts(w, at, block):
        data += piece
        while len(data) >= 5:
            if not data.startswith(b"WARC/"):
                return
            if held:
                yield held
                held = None
            size = record_size(data)
            if size is None or len(data) < size:
                if after >= 0:
                    return
                break
            held = number, *parse_record(bytes(data[:size]))
            number += 1
            del data[:size]
            while data[:2] == b"\r\n":
                del data[:2]
        if held and data[:2] == b"\r\n":  # the pair of line ends behind a record, cut by pieces
            while data[:2] == b"\r\n":
                del data[:2]
        if after >= 0 and held:
            yield held
            yield after


def record_size(data: bytearray) -> int | None:
    """Bytes of the record at the start of ``data``, without the line ends behind it; None if its head isn't whole or states no length."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    m = re.search(rb"(?i)\r\ncontent-length[ \t]*:[ \t]*([0-9]+)[ \t]*\r\n", bytes(data[: end + 2]))
    return end + 4 + int(m[1]) if m else None


def records(w: _Window, start: int, end: int, block: int = _BLOCK) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, number, headers, block) of the records of the gzip members that begin in [start, end), number counting a member's records.

    The range is scanned for gzip magic; a candidate counts if it decompresses to WARC records to its end, and the scan goes on after it,
    else behind its first byte. A member that begins inside is read to its end, beyond ``end`` if need be.
    """
    at = start
    while at < end:
        raw = w.read(at, min(block, end - at) + len(MAGIC) - 1)
        hit = raw.find(MAGIC)
        if hit < 0 or at + hit >= end:
            at += max(1, len(raw) - len(MAGIC) + 1)
            if not raw:
                return
            continue
        at += hit
        while at < end:
            after = 0
            for found in _member(w, at, block):
                if isinstance(found, int):
                    after = found
                else:
                    yield at, *found
            if not after:
                at += 1
                break
            at = after


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 32 << 20))

    def partitions(self) -> list[_Range]:
        f, path = filesystem(self.path)
        info = f.get_file_info(path)
        infos = [info] if info.type == pafs.FileType.File else f.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))
        return [_Range(p, a, min(a + self.split, n)) for p, n in files for a in range(0, n, self.split)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        f, _ = filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        with f.open_input_file(partition.path) as file:
            for at, number, h, payload in records(_Window(file, file.size()), partition.start, partition.end):
                rows.append((partition.path, at, number, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), list(h.items()), payload))
                size += len(payload)
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``: the records of a gzipped WARC file or folder, read in byte ranges of ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The records of the gzipped WARC file or folder at ``path``, whatever task reads which bytes; a gzip member may hold any number of them.

    A path without a scheme is one of the default file system. Bytes that aren't a record (damage, plain gzip members, padding) are passed over; a cut-off last record is left out; records without
    target or date have nulls there; an empty file or folder gives an empty result. Header names are in lower case. Records of any length
    are returned whole. Repeated records are returned each time.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", qualified(spark, path)).option("splitBytes", split_bytes).load()


def warc_member(record_type: str, uri: str | None, payload: bytes, record_id: str, date: str, extra: dict[str, str], content_type: str, level: int = 6) -> bytes:
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri}")
    head += [f"{k}: {v}" for k, v in extra.items()] + [f"Content-Type: {content_type}", f"Content-Length: {len(payload)}"]
    return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n", level, mtime=0)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> None:
    """Each (page_id, url, html) as a resource record, in one gzipped WARC file for each task under ``path``.

    A task writes under a passing name and at its end takes the name of its partition, so a task that is run again, after a loss or beside
    a slow one, replaces its file. Null url: no target URI; null html: no bytes, marked by the Content-Type; null page_id: no X-Page-Id.
    """
    path = qualified(pages.sparkSession, path)
    f, base = filesystem(path)
    f.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, at = filesystem(path)
        name = f"{at}/.{uuid.uuid4().hex}"
        n = 0
        with g.open_output_stream(name, compression=None) as out:
            for b in batches:
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    n += 1
                    extra = {} if page_id is None else {"X-Page-Id": str(page_id)}
                    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                    kind = "application/x-none" if html is None else "text/html; charset=utf-8"
                    key = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
                    out.write(warc_member("resource", uri, (html or "").encode("utf-8", "surrogatepass"), str(key), date, extra, kind, level))
        end = f"{at}/part-{TaskContext.get().partitionId():07d}.warc.gz"
        if g.get_file_info(end).type == pafs.FileType.File:
            g.delete_file(end)
        g.move(name, end)
        yield pa.RecordBatch.from_pydict({"n": [n]}, pa.schema([("n", pa.int64())]))

    only(pages, "page_id", "url", "html").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html) of resource records that ``write_warc`` wrote.

    Records without target have a null url, those of null html a null html, those without X-Page-Id a null page_id; empty and long pages
    come back as they were, repeated ones each time; records of other kinds give what their headers and block hold; no records give no rows.
    """
    html = F.when(F.col("content_type") != "application/x-none", F.decode("payload", "utf-8"))
    return records.select(F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("uri").alias("url"), html.alias("html"))


def op9_warc_reader(spark, sf_dir: str) -> DataFrame:
    """The pages, written as WARC and read back from byte ranges: the same rows, with nulls, empty and repeated ones; extra columns are left out."""
    path = delete_at_exit(spark, scratch_path(spark, "warc"))
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(read_warc(spark, path, 1 << 20))


QUERIES = {"op9_warc_reader": op9_warc_reader}
ORACLE = {"op9_warc_reader": "SELECT page_id, url, html FROM pages"}
