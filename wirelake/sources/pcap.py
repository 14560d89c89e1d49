"""Capture files (classic and pcapng) as a Spark source, dissected in Python: Ethernet, ARP, IPv4, IPv6, ICMP, TCP, UDP, DNS, HTTP/1, TLS.

``spark.read.format("wirelake_pcap").option("path", ...).option("fields", "ip.src,tcp.port").load()`` gives an array<string> column for each
field, as a dissector program prints them. Only what the fields need is dissected; ``FIELDS`` names all there are, others are an error. Frame
and stream numbers count from a capture's start; a capture is a file or, if ``read_pcap`` is told so, a folder whose files continue one another.
``read_pcap`` reads large classic files in ranges, after a pass that finds packets' places. Where stream numbers are asked for of a capture that
is said to continue, another pass finds out which conversations go on in each range. A file of the other format is one partition.
"""

from __future__ import annotations

import base64
import io
import json
import socket
import struct
from collections.abc import Callable, Iterable, Iterator
from ipaddress import IPv6Address

import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wirelake.errors import FieldNotDissectedError, FieldNotProjectedError
from wirelake.scratch import scratch_folder

_BATCH = 8192
_FLAGS = ("fin", "syn", "reset", "push", "ack", "urg", "ece", "cwr")
_REQUEST = (b"GET ", b"POST ", b"PUT ", b"HEAD ", b"DELETE ", b"OPTIONS ", b"PATCH ", b"CONNECT ", b"TRACE ")
#: HTTP header lines that are fields.
_HEADERS = {
    b"host": "http.host", b"user-agent": "http.user_agent", b"content-type": "http.content_type", b"content-length": "http.content_length_header", b"server": "http.server", b"referer": "http.referer",
    b"cookie": "http.cookie", b"location": "http.location", b"connection": "http.connection", b"accept": "http.accept", b"date": "http.date", b"set-cookie": "http.set_cookie",
    b"authorization": "http.authorization", b"transfer-encoding": "http.transfer_encoding", b"content-encoding": "http.content_encoding", b"accept-language": "http.accept_language", b"accept-encoding": "http.accept_encoding",
}


def _names(layer: str, text: str) -> frozenset[str]:
    return frozenset(f"{layer}.{x}" for x in text.split())


_LAYERS: dict[str, frozenset[str]] = {
    "frame": _names("frame", "number time time_epoch len cap_len time_relative time_delta"),
    "link": _names("eth", "dst src addr type") | {"vlan.id"} | _names("arp", "opcode src.hw_mac src.proto_ipv4 dst.hw_mac dst.proto_ipv4"),
    "ip": _names("ip", "version hdr_len dsfield len id flags flags.rb flags.df flags.mf frag_offset ttl proto checksum src dst addr src_host dst_host")
    | _names("ipv6", "version tclass flow plen nxt hlim src dst addr"),
    "icmp": _names("icmp", "type code checksum ident seq") | _names("icmpv6", "type code checksum"),
    "tcp": _names("tcp", "srcport dstport port stream seq_raw ack_raw seq ack hdr_len flags window_size_value checksum urgent_pointer options len payload " + " ".join(f"flags.{f}" for f in _FLAGS)),
    "udp": _names("udp", "srcport dstport port stream length checksum payload"),
    "dns": _names("dns", "id flags flags.response flags.opcode flags.rcode count.queries count.answers qry.name qry.type qry.class resp.name resp.type resp.ttl a aaaa cname"),
    "http": frozenset(_HEADERS.values()) | _names("http", "request response request.method request.uri request.version response.version response.code response.phrase"),
    "tls": _names("tls", "record.content_type record.version record.length handshake.type handshake.version handshake.extensions_server_name"),
}
#: All fields that this dissector has. A packet without one of them doesn't have it; other fields aren't absent but unknown.
FIELDS = frozenset().union(*_LAYERS.values())
_LAYER_OF = {n: layer for layer, names in _LAYERS.items() for n in names}
#: Fields that only a capture's whole course tells.
_IN_ORDER = frozenset(("tcp.stream", "udp.stream", "tcp.seq", "tcp.ack"))


def check_fields(names: Iterable[str]) -> None:
    if unknown := sorted(set(names) - FIELDS):
        raise FieldNotDissectedError(f"the built-in dissector doesn't have {', '.join(unknown)}: use a dissector program")


def packets(file) -> Iterator[tuple[int, int, int, bytes]]:
    """(microseconds, original length, link type, bytes) of a classic capture file or pcapng; a cut-off last packet ends it."""
    head = file.read(4)
    if head == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(file)
        return
    head += file.read(20)
    if len(head) < 24:
        if head:
            raise ValueError("a capture file starts with 24 bytes")
        return
    yield from _classic(file, head)


_KINDS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def _classic(file, head: bytes, at: int = 24, end: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """The packets from ``at``, where ``file`` stands, up to ``end``."""
    if head[:4] not in _KINDS:
        raise ValueError(f"no capture file: it starts with {head[:4].hex()}")
    order, part = _KINDS[head[:4]]
    link = struct.unpack(order + "I", head[20:24])[0] & 0xFFFF
    record = struct.Struct(order + "IIII")
    while (end is None or at < end) and len(h := file.read(16)) == 16:
        seconds, fraction, kept, length = record.unpack(h)
        data = file.read(kept)
        if len(data) < kept:
            return
        at += 16 + kept
        yield seconds * 1_000_000 + fraction // part, length, link, data


def ranges(file, split: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(start, end, packets before, time of the file's first packet, time of the packet before, packets, time of the last one) of ranges of a
    classic file; none for other files.

    Only packets' heads are looked at.
    """
    head = file.read(24)
    if len(head) < 24 or head[:4] not in _KINDS:
        return
    order, part = _KINDS[head[:4]]
    record = struct.Struct(order + "IIII")
    data, base, at = b"", 24, 24  # what is read, where it begins, the next packet
    start, frames, before = 24, 0, 0
    state = None
    while True:
        if at + 16 > base + len(data):
            if at > base + len(data) + (64 << 20):
                file.seek(at)
                data, base = b"", at
            while at + 16 > base + len(data):
                more = file.read(1 << 20)
                if not more:
                    break
                data, base = (data[max(0, at - base) :] + more, max(at, base)) if at - base <= len(data) else (more, base + len(data))
            if at + 16 > base + len(data):
                break
        seconds, fraction, kept, _ = record.unpack_from(data, at - base)
        micros = seconds * 1_000_000 + fraction // part
        if state is None:
            state = (frames, micros, micros)
            first = micros
        elif at - start >= split:
            yield start, at, *state, frames - state[0], before
            start, state = at, (frames, first, before)
        before = micros
        frames += 1
        at += 16 + kept
    if state is not None:
        yield start, at, *state, frames - state[0], before


def _extent(file) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """The same of a whole file of either format, as one range that ends at 0."""
    n = first = last = 0
    for n, p in enumerate(packets(file), 1):
        first, last = (p[0] if n == 1 else first), p[0]
    if n:
        yield 0, 0, 0, first, first, n, last


def _blocks(file) -> Iterator[tuple[int, int, int, bytes]]:
    """The packets of a pcapng file behind its first block type: sections of either byte order, several interfaces, any time resolution."""
    kind, end = 0x0A0D0D0A, "<"
    interfaces: list[tuple[int, int, int, int]] = []  # link type, units a second, seconds to add, most bytes kept
    first = True
    while True:
        raw = b"" if first else file.read(4)
        if not first:
            if len(raw) < 4:
                return
            kind = struct.unpack(end + "I", raw)[0]
        first = False
        size = file.read(4)
        body = b""
        if kind == 0x0A0D0D0A:
            body = file.read(4)
            if len(body) < 4:
                return
            if body not in (b"\x4d\x3c\x2b\x1a", b"\x1a\x2b\x3c\x4d"):
                raise ValueError(f"no pcapng section: byte order {body.hex()}")
            end = "<" if body == b"\x4d\x3c\x2b\x1a" else ">"
            interfaces = []
        if len(size) < 4:
            return
        total = struct.unpack(end + "I", size)[0]
        if total < 12 or total % 4:
            raise ValueError(f"a pcapng block of {total} bytes")
        body += file.read(total - 8 - len(body))
        if len(body) < total - 8:
            return
        if kind == 1:
            link, most = struct.unpack(end + "HxxI", body[:8])
            units, offset, at = 1_000_000, 0, 8
            while at + 4 <= len(body) - 4:
                code, n = struct.unpack(end + "HH", body[at : at + 4])
                value = body[at + 4 : at + 4 + n]
                if code == 9 and n == 1:
                    units = 1 << (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
                elif code == 14 and n == 8:
                    offset = struct.unpack(end + "q", value)[0]
                elif code == 0:
                    break
                at += 4 + n + -n % 4
            interfaces.append((link, units, offset, most))
        elif kind in (2, 6) and len(body) >= 24:
            which, high, low, kept, length = struct.unpack(end + ("IIIII" if kind == 6 else "HxxIIII"), body[:20])
            if which >= len(interfaces):
                raise ValueError(f"a packet of interface {which}, which the file doesn't have")
            link, units, offset, _ = interfaces[which]
            yield (high << 32 | low) * 1_000_000 // units + offset * 1_000_000, length, link, body[20 : 20 + kept]
        elif kind == 3 and interfaces:
            length = struct.unpack(end + "I", body[:4])[0]
            link, _, _, most = interfaces[0]
            yield 0, length, link, body[4 : 4 + (min(length, most) if most else length)]


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A DNS name and the place after it; pointers only go backwards."""
    labels, after, least = [], None, at
    while at < len(data):
        n = data[at]
        if n >= 0xC0:
            if at + 1 >= len(data):
                break
            to = (n & 0x3F) << 8 | data[at + 1]
            after = at + 2 if after is None else after
            if to >= least:
                break
            at = least = to
        elif n == 0:
            at += 1
            break
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n
    return ".".join(labels) or "<Root>", at if after is None else after


class Dissector:
    """Dissects one capture's packets in order: it numbers frames and streams. Layers that no wanted field needs aren't looked at."""

    def __init__(self, wanted: Iterable[str] = FIELDS) -> None:
        self.frame, self.first, self.before = 0, 0, 0
        self.streams: dict[str, dict[tuple, int]] = {"tcp": {}, "udp": {}}
        self.count = {"tcp": 0, "udp": 0}
        self.bases: dict[tuple, int] = {}  # first sequence numbers by stream and sender
        w = set(wanted)
        self.want = {k: not names.isdisjoint(w) for k, names in _LAYERS.items()}
        self.numbered = not w.isdisjoint(_IN_ORDER)
        self._reach()

    def _reach(self) -> None:
        self.deep = self.numbered or any(self.want[k] for k in ("icmp", "tcp", "udp", "dns", "http", "tls"))
        self.addresses = self.want["ip"] or self.numbered

    def has(self, name: str) -> bool:
        """Whether the layer of ``name`` is dissected."""
        return self.want[_LAYER_OF[name]]

    def also(self, name: str, frame: int) -> dict[str, list[str]]:
        """The fields of the packet in hand, which has to be ``frame``, with those of the layer of ``name``; later packets have that layer too."""
        if frame != self.frame:
            raise FieldNotProjectedError(f"{name} is asked of a packet that is over: a predicate keeps values, not packets")
        self.want[_LAYER_OF[name]] = True
        self._reach()
        micros, length, link, data, self.before = self.last
        self.frame -= 1
        return self.fields(micros, length, link, data)

    def fields(self, micros: int, length: int, link: int, data: bytes) -> dict[str, list[str]]:
        self.frame += 1
        out: dict[str, list[str]] = {}
        if self.frame == 1:
            self.first = self.before = micros
        self.last = micros, length, link, data, self.before
        if self.want["frame"]:
            out = {
                "frame.number": [str(self.frame)],
                "frame.time": [_seconds(micros)],
                "frame.time_epoch": [_seconds(micros)],
                "frame.len": [str(length)],
                "frame.cap_len": [str(len(data))],
                "frame.time_relative": [_seconds(micros - self.first)],
                "frame.time_delta": [_seconds(micros - self.before)],
            }
        self.before = micros
        try:
            if link == 1 and len(data) >= 14:
                kind, at = data[12] << 8 | data[13], 14
                if self.want["link"]:
                    dst, src = data[:6].hex(":"), data[6:12].hex(":")
                    out |= {"eth.dst": [dst], "eth.src": [src], "eth.addr": [dst, src]}
                while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
                    out.setdefault("vlan.id", []).append(str(int.from_bytes(data[at : at + 2], "big") & 0xFFF))
                    kind, at = int.from_bytes(data[at + 2 : at + 4], "big"), at + 4
                if self.want["link"]:
                    out["eth.type"] = [hex4(kind)]
                self._network(out, kind, data[at:])
            elif link in (101, 12, 14, 228, 229) and data:
                self._network(out, 0x0800 if data[0] >> 4 == 4 else 0x86DD, data)
            elif link == 113 and len(data) >= 16:
                self._network(out, int.from_bytes(data[14:16], "big"), data[16:])
        except (IndexError, struct.error):
            pass  # a cut-off packet has the fields up to there
        return out

    def _network(self, out: dict, kind: int, d: bytes) -> None:
        if kind == 0x0806 and len(d) >= 28:
            if self.want["link"]:
                out |= {"arp.opcode": [str(int.from_bytes(d[6:8], "big"))], "arp.src.hw_mac": [d[8:14].hex(":")], "arp.src.proto_ipv4": [socket.inet_ntoa(d[14:18])], "arp.dst.hw_mac": [d[18:24].hex(":")], "arp.dst.proto_ipv4": [socket.inet_ntoa(d[24:28])]}
        elif kind == 0x0800 and len(d) >= 20:
            size = (d[0] & 15) * 4
            total, ident, frag = struct.unpack(">HHH", d[2:8])
            src = dst = ""
            if self.addresses:
                src, dst = socket.inet_ntoa(d[12:16]), socket.inet_ntoa(d[16:20])
            if self.want["ip"]:
                out |= {
                    "ip.version": ["4"], "ip.hdr_len": [str(size)], "ip.dsfield": [f"0x{d[1]:02x}"], "ip.len": [str(total)], "ip.id": [hex4(ident)], "ip.flags": [f"0x{frag >> 13:02x}"], "ip.flags.rb": [str(frag >> 15)],
                    "ip.flags.df": [str(frag >> 14 & 1)], "ip.flags.mf": [str(frag >> 13 & 1)], "ip.frag_offset": [str((frag & 0x1FFF) * 8)], "ip.ttl": [str(d[8])], "ip.proto": [str(d[9])],
                    "ip.checksum": [hex4(d[10] << 8 | d[11])], "ip.src": [src], "ip.dst": [dst], "ip.addr": [src, dst], "ip.src_host": [src], "ip.dst_host": [dst],
                }
            if self.deep and not frag & 0x1FFF:
                self._transport(out, d[9], d[size : max(total, size)] if total else d[size:], src, dst)
        elif kind == 0x86DD and len(d) >= 40:
            src = dst = ""
            if self.addresses:
                src, dst = str(IPv6Address(d[8:24])), str(IPv6Address(d[24:40]))
            if self.want["ip"]:
                word = int.from_bytes(d[:4], "big")
                out |= {"ipv6.version": ["6"], "ipv6.tclass": [f"0x{word >> 20 & 255:02x}"], "ipv6.flow": [f"0x{word & 0xFFFFF:05x}"], "ipv6.plen": [str(int.from_bytes(d[4:6], "big"))], "ipv6.nxt": [str(d[6])], "ipv6.hlim": [str(d[7])], "ipv6.src": [src], "ipv6.dst": [dst], "ipv6.addr": [src, dst]}
            if self.deep:
                kind, at, whole = d[6], 40, True
                while kind in (0, 43, 44, 60):
                    if kind == 44:
                        whole = not int.from_bytes(d[at + 2 : at + 4], "big") >> 3
                        kind, at = d[at], at + 8
                    else:
                        kind, at = d[at], at + 8 + d[at + 1] * 8
                if whole:
                    self._transport(out, kind, d[at:], src, dst)

    def _transport(self, out: dict, proto: int, d: bytes, src: str, dst: str) -> None:
        if proto in (1, 58) and len(d) >= 4:
            if self.want["icmp"]:
                name = "icmp" if proto == 1 else "icmpv6"
                out |= {f"{name}.type": [str(d[0])], f"{name}.code": [str(d[1])], f"{name}.checksum": [hex4(d[2] << 8 | d[3])]}
                if proto == 1 and d[0] in (0, 8) and len(d) >= 8:
                    out |= {"icmp.ident": [str(d[4] << 8 | d[5])], "icmp.seq": [str(d[6] << 8 | d[7])]}
            return
        if proto not in (6, 17) or len(d) < 8:
            return
        name = "tcp" if proto == 6 else "udp"
        sport, dport = d[0] << 8 | d[1], d[2] << 8 | d[3]
        stream = self._stream(name, src, sport, dst, dport, d) if self.numbered else 0
        if self.want[name]:
            p, q = str(sport), str(dport)
            out |= {f"{name}.srcport": [p], f"{name}.dstport": [q], f"{name}.port": [p, q], f"{name}.stream": [str(stream)]}
        if name == "udp":
            if self.want["udp"]:
                out |= {"udp.length": [str(d[4] << 8 | d[5])], "udp.checksum": [hex4(d[6] << 8 | d[7])]}
                if d[8:]:
                    out["udp.payload"] = [d[8:].hex(":")]
            if self.want["dns"] and 53 in (sport, dport) and len(d) >= 20:
                self._dns(out, d[8:])
            return
        if len(d) < 20:
            return
        seq, ack, word, window, check, urgent = struct.unpack(">IIHHHH", d[4:20])
        size = (word >> 12) * 4
        body = d[size:]
        if self.want["tcp"]:
            out |= {"tcp.seq_raw": [str(seq)], "tcp.ack_raw": [str(ack)], "tcp.hdr_len": [str(size)], "tcp.flags": [hex4(word & 0xFFF)], "tcp.window_size_value": [str(window)], "tcp.checksum": [hex4(check)], "tcp.urgent_pointer": [str(urgent)], "tcp.len": [str(len(body))]}
            for i, f in enumerate(_FLAGS):
                out[f"tcp.flags.{f}"] = ["1" if word >> i & 1 else "0"]
            if self.numbered:
                out["tcp.seq"] = [str((seq - self.bases.get((stream, src, sport), seq)) % 2**32)]
                theirs = self.bases.get((stream, dst, dport))
                out["tcp.ack"] = [str((ack - theirs) % 2**32 if theirs is not None and word & 16 else ack)]
            if size > 20:
                out["tcp.options"] = [d[20:size].hex(":")]
            if body:
                out["tcp.payload"] = [body.hex(":")]
        if body:
            if self.want["tls"] and body[0] in (20, 21, 22, 23) and body[1:2] == b"\x03":
                self._tls(out, body)
            elif self.want["http"] and (body.startswith(b"HTTP/1.") or body.startswith(_REQUEST)):
                self._http(out, body)
            if self.want["dns"] and 53 in (sport, dport) and len(body) >= 14:
                self._dns(out, body[2:])

    def _stream(self, name: str, src: str, sport: int, dst: str, dport: int, d: bytes) -> int:
        """A conversation's number; a new opening of the same ends, with another first sequence number, is another conversation."""
        ends = tuple(sorted(((src, sport), (dst, dport))))
        known = self.streams[name]
        stream = known.get(ends)
        if name == "tcp" and len(d) >= 14:
            seq, flags = int.from_bytes(d[4:8], "big"), d[13]
            base = None if stream is None else self.bases.get((stream, src, sport))
            if flags & 0x12 == 2 and base not in (None, seq):
                stream = base = None
            if stream is None:
                stream = known[ends] = self.count[name]
                self.count[name] += 1
            if base is None:
                # a stream that is seen from its middle counts from 1, as one whose opening is seen does behind it
                self.bases[(stream, src, sport)] = seq if flags & 2 else (seq - 1) % 2**32
            return stream
        if stream is None:
            stream = known[ends] = self.count[name]
            self.count[name] += 1
        return stream

    def _http(self, out: dict, d: bytes) -> None:
        lines = d.partition(b"\r\n\r\n")[0].split(b"\r\n")
        first = [x.decode("utf-8", "replace") for x in lines[0].split(b" ", 2)]
        if len(first) < 2:
            return
        if first[0].startswith("HTTP/"):
            out |= {"http.response": ["1"], "http.response.version": [first[0]], "http.response.code": [first[1]]}
            if len(first) == 3:
                out["http.response.phrase"] = [first[2]]
        else:
            out |= {"http.request": ["1"], "http.request.method": [first[0]], "http.request.uri": [first[1]]}
            if len(first) == 3:
                out["http.request.version"] = [first[2]]
        for line in lines[1:]:
            name, found, value = line.partition(b":")
            if found and (field := _HEADERS.get(name.strip().lower())):
                out.setdefault(field, []).append(value.strip().decode("utf-8", "replace"))

    def _tls(self, out: dict, d: bytes) -> None:
        at = 0
        while at + 5 <= len(d) and d[at] in (20, 21, 22, 23) and d[at + 1] == 3:
            n = d[at + 3] << 8 | d[at + 4]
            out.setdefault("tls.record.content_type", []).append(str(d[at]))
            out.setdefault("tls.record.version", []).append(hex4(d[at + 1] << 8 | d[at + 2]))
            out.setdefault("tls.record.length", []).append(str(n))
            body = d[at + 5 : at + 5 + n]
            if d[at] == 22 and len(body) >= 6 and body[0] in (1, 2):
                out.setdefault("tls.handshake.type", []).append(str(body[0]))
                out.setdefault("tls.handshake.version", []).append(hex4(body[4] << 8 | body[5]))
                if body[0] == 1:
                    self._hello(out, body)
            at += 5 + n

    def _hello(self, out: dict, b: bytes) -> None:
        at = 38
        at += 1 + b[at]
        at += 2 + (b[at] << 8 | b[at + 1])
        at += 1 + b[at]
        end = min(len(b), at + 2 + (b[at] << 8 | b[at + 1]))
        at += 2
        while at + 4 <= end:
            kind, n = struct.unpack(">HH", b[at : at + 4])
            if kind == 0 and n >= 5:
                size = b[at + 7] << 8 | b[at + 8]
                out.setdefault("tls.handshake.extensions_server_name", []).append(b[at + 9 : at + 9 + size].decode("utf-8", "replace"))
            at += 4 + n

    def _dns(self, out: dict, d: bytes) -> None:
        ident, flags, questions, answers = struct.unpack(">HHHH", d[:8])
        out |= {"dns.id": [hex4(ident)], "dns.flags": [hex4(flags)], "dns.flags.response": [str(flags >> 15)], "dns.flags.opcode": [str(flags >> 11 & 15)], "dns.flags.rcode": [str(flags & 15)], "dns.count.queries": [str(questions)], "dns.count.answers": [str(answers)]}
        at = 12
        for _ in range(questions):
            name, at = _name(d, at)
            kind, group = struct.unpack(">HH", d[at : at + 4])
            at += 4
            out.setdefault("dns.qry.name", []).append(name)
            out.setdefault("dns.qry.type", []).append(str(kind))
            out.setdefault("dns.qry.class", []).append(hex4(group))
        for _ in range(answers):
            name, at = _name(d, at)
            kind, _, ttl, n = struct.unpack(">HHIH", d[at : at + 10])
            body, at = d[at + 10 : at + 10 + n], at + 10 + n
            out.setdefault("dns.resp.name", []).append(name)
            out.setdefault("dns.resp.type", []).append(str(kind))
            out.setdefault("dns.resp.ttl", []).append(str(ttl))
            if kind == 1 and n == 4:
                out.setdefault("dns.a", []).append(socket.inet_ntoa(body))
            elif kind == 28 and n == 16:
                out.setdefault("dns.aaaa", []).append(str(IPv6Address(body)))
            elif kind == 5:
                out.setdefault("dns.cname", []).append(_name(d, at - n)[0])


class _Scout(Dissector):
    """Notes the packets of a range on which conversations' numbers can depend, whatever went before it: the first of each sender, those
    that may open a conversation anew, and the first of each sender behind such a one. They are as many as conversations, not as packets."""

    def __init__(self) -> None:
        super().__init__(("tcp.stream",))
        self.want = dict.fromkeys(self.want, False)
        self.notes: list[tuple] = []
        self.seen: dict[tuple, int] = {}

    def _stream(self, name: str, src: str, sport: int, dst: str, dport: int, d: bytes) -> int:
        a, b = sorted(((src, sport), (dst, dport)))
        side, seq, flags = 2, None, 0
        if name == "tcp" and len(d) >= 14:
            side, seq, flags = int((src, sport) != a), int.from_bytes(d[4:8], "big"), d[13]
        seen = 0 if flags & 0x12 == 2 else self.seen.get((name, a, b), 0)
        if not seen >> side & 1:
            self.seen[name, a, b] = seen | 1 << side
            self.notes.append((name, *a, *b, self.frame, side, seq, flags))
        return 0


_NOTES = "part int, capture int, name string, a string, a_port int, b string, b_port int, frame long, side int, seq long, flags int"
_HEADS = "path string, start long, end long, frames long, first long, before long, count long, last long"
_COURSE = "part int, capture int, name string, a string, a_port int, b string, b_port int, opened long, carried boolean, base_a long, base_b long"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _courses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' courses from all their notes in order, by the rules of ``Dissector._stream``: where one opens, and, for each range in
    which it goes on, the packet that opened it and its first sequence numbers so far."""
    key: tuple | None = None
    part = opened = None
    bases: list = [None, None]
    for batch in batches:
        out: list[tuple] = []
        for at, *ends, frame, side, seq, flags in zip(*(c.to_pylist() for c in batch.columns)):
            if ends != key:
                key, part, opened, bases = ends, at, None, [None, None]
            elif at != part:
                part = at
                out.append((at, *ends, opened, True, *bases))
            base = None if seq is None or opened is None else bases[side]
            if opened is None or seq is not None and flags & 0x12 == 2 and base not in (None, seq):
                opened, base, bases = frame, None, [None, None]
                out.append((at, *ends, frame, False, None, None))
            if seq is not None and base is None:
                bases[side] = seq if flags & 2 else (seq - 1) % 2**32
        yield _batch_of(out, _COURSE)


def hex4(x: int) -> str:
    return f"0x{x:04x}"


def _seconds(micros: int) -> str:
    sign, micros = ("-", -micros) if micros < 0 else ("", micros)
    return f"{sign}{micros // 1_000_000}.{micros % 1_000_000:06d}000"


class _File(InputPartition):
    """A file, or the range [start, end) of one; ``frames`` packets of its capture are before it."""

    def __init__(self, path: str, start: int = 0, end: int = 0, frames: int = 0, first: int = 0, before: int = 0, capture: int = 0, part: int = -1):
        self.path, self.start, self.end, self.frames, self.first, self.before, self.capture, self.part = path, start, end, frames, first, before, capture, part


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path, and the path on it; one without a scheme is the local file system's."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, that of the default file system if it names none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    f, at = filesystem(path)
    info = f.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [info] if info.type == pafs.FileType.File else f.get_file_info(pafs.FileSelector(at))
    return f, sorted((i for i in infos if i.type == pafs.FileType.File and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)


class _Reader(DataSourceReader):
    """``look``: what is read, the fields of packets, the places of packets ("heads") or where conversations may open ("notes")."""

    def __init__(self, path: str, names: list[str], look: str, options: dict):
        self.path, self.names, self.look = path, names, look
        self.index = json.loads(options.get("index", "[]"))
        self.counts = json.loads(options.get("counts", "[]"))
        self.state, self.test, self.whole = options.get("state"), options.get("test"), options.get("whole") == "true"
        self.wanted = [n for n in options.get("wanted", "").split(",") if n]
        self.split, self.continued = int(options.get("split", "0")), options.get("continued") == "true"

    def partitions(self) -> list[_File]:
        parted = {x[0] for x in self.index}
        there = [_File(*x, part=i) for i, x in enumerate(self.index)]
        if self.look == "heads":
            return [_File(i.path) for i in _files(self.path)[1] if self.continued or i.size > self.split] or [_File("")]
        if self.look == "notes":
            return there or [_File("")]
        return there + [_File(i.path) for i in _files(self.path)[1] if i.path not in parted] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        f, _ = filesystem(self.path)
        with io.BufferedReader(f.open_input_file(partition.path), 1 << 20) as file:
            yield from {"heads": self._heads, "notes": self._notes, "fields": self._fields}[self.look](partition, file)

    def _heads(self, partition: _File, file) -> Iterator[pa.RecordBatch]:
        found = list(ranges(file, self.split))
        if not found and self.continued:
            file.seek(0)
            found = list(_extent(file))
        yield _batch_of([(partition.path, *r) for r in found], _HEADS)

    def _opened(self, partition: _File, file, d: Dissector) -> Iterator[tuple[int, int, int, bytes]]:
        d.frame, d.first, d.before = partition.frames, partition.first, partition.before
        if not partition.end:
            return packets(file)
        head = file.read(24)
        file.seek(partition.start)
        return _classic(file, head, partition.start, partition.end)

    def _notes(self, partition: _File, file) -> Iterator[pa.RecordBatch]:
        d = _Scout()
        for p in self._opened(partition, file, d):
            d.fields(*p)
            if len(d.notes) >= _BATCH:
                yield _batch_of([(partition.part, partition.capture, *n) for n in d.notes], _NOTES)
                d.notes.clear()
        yield _batch_of([(partition.part, partition.capture, *n) for n in d.notes], _NOTES)

    def _dissector(self, partition: _File) -> Dissector:
        d = Dissector([*self.names, *self.wanted])
        if self.whole:
            d.numbered = True
            d._reach()
        if partition.part >= 0 and self.state:
            d.count = dict(zip(("tcp", "udp"), self.counts[partition.part]))
            f, at = filesystem(f"{self.state}/part={partition.part}")
            for i in f.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if i.base_name.endswith(".parquet"):
                    for b in pq.ParquetFile(f.open_input_file(i.path)).iter_batches():
                        for name, a, a_port, other, b_port, number, base_a, base_b in zip(*(b.column(c).to_pylist() for c in ("name", "a", "a_port", "b", "b_port", "number", "base_a", "base_b"))):
                            d.streams[name][(a, a_port), (other, b_port)] = number
                            for ends, base in (((a, a_port), base_a), ((other, b_port), base_b)):
                                if base is not None:
                                    d.bases[(number, *ends)] = base
        return d

    def _fields(self, partition: _File, file) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        schema = pa.schema([(n, kind) for n in self.names])
        d = self._dissector(partition)
        passes = cloudpickle.loads(base64.b64decode(self.test)) if self.test else None
        columns: list[tuple[str, list]] = [(n, []) for n in self.names]
        none: list[str] = []
        rows = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for _, c in columns], schema=schema)
            for _, c in columns:
                c.clear()
            return out

        for p in self._opened(partition, file, d):
            found = d.fields(*p)
            if passes is not None and not passes(found, d):
                continue
            for n, c in columns:
                c.append(found.get(n, none))
            rows += 1
            if rows % _BATCH == 0:
                yield batch()
        if rows % _BATCH:
            yield batch()


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wirelake_pcap"

    def _names(self) -> list[str]:
        return [n for n in self.options.get("fields", "frame.number,frame.time_epoch,frame.len").split(",") if n]

    def schema(self) -> str:
        look = self.options.get("look", "fields")
        if look != "fields":
            return {"heads": _HEADS, "notes": _NOTES}[look]
        check_fields(self._names())
        return ", ".join(f"`{n}` array<string>" for n in self._names())

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], schema.names, self.options.get("look", "fields"), dict(self.options))


def _source(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return spark.read.format("wirelake_pcap").option("path", path).options(**options).load()


def _index(spark: SparkSession, path: str, split: int, continued: bool) -> list[tuple]:
    """(path, start, end, packets before, time of the capture's first packet, of the packet before, number of the capture) of all ranges, in order."""
    found = sorted(tuple(r) for r in _source(spark, path, look="heads", split=split, continued=str(continued).lower()).collect())  # as many rows as ranges
    out: list[tuple] = []
    capture, frames = -1, 0
    for at, start, end, before_it, first, before, count, last in found:
        if continued:
            if capture < 0:
                capture, opening, previous = 0, first, first
            out.append((at, start, end, frames, opening, previous, 0))
            frames, previous = frames + count, last
        else:
            capture += before_it == 0
            out.append((at, start, end, before_it, first, before, capture))
    return out


def _course(spark: SparkSession, path: str, index: list[tuple]) -> dict[str, str]:
    """Options with what the ranges' dissectors have to know of conversations: how many were opened before, and which go on.

    A range has a file of those that it goes on with; the driver gets two numbers of each range.
    """
    ends = ["capture", "name", "a", "a_port", "b", "b_port"]
    at = scratch_folder(spark, "conversations")
    notes = _source(spark, path, look="notes", index=json.dumps(index))
    notes.repartition(*ends).sortWithinPartitions(*ends, "frame").mapInArrow(_courses, _COURSE).write.parquet(f"{at}-courses")
    courses = spark.read.schema(_COURSE).parquet(f"{at}-courses")
    opened = courses.filter("NOT carried")
    many = {(r["part"], r["name"]): r["count"] for r in opened.groupBy("part", "name").count().collect()}
    counts: list[list[int]] = []
    for i, x in enumerate(index):
        new = i == 0 or index[i - 1][6] != x[6]
        counts.append([0, 0] if new else [counts[-1][k] + many.get((i - 1, name), 0) for k, name in enumerate(("tcp", "udp"))])
    base = spark.createDataFrame([(i, name, c[k]) for i, c in enumerate(counts) for k, name in enumerate(("tcp", "udp"))], "part int, name string, earlier long")
    within = F.row_number().over(Window.partitionBy("part", "name").orderBy("opened"))
    numbers = opened.withColumn("within", within).join(F.broadcast(base), ["part", "name"]).select("capture", "name", "opened", (F.col("earlier") + F.col("within") - 1).alias("number"))
    carried = courses.filter("carried").join(numbers, ["capture", "name", "opened"]).select("part", "name", "a", "a_port", "b", "b_port", "number", "base_a", "base_b")
    carried.repartition("part").write.partitionBy("part").parquet(at)
    return {"state": qualified(spark, at), "counts": json.dumps(counts)}


def read_pcap(spark: SparkSession, path: str, names: list[str], split_bytes: int = 64 << 20, continued: bool = False, wanted: Iterable[str] = (), whole: bool = False, test: Callable | None = None) -> DataFrame:
    """Raw columns of a capture file, or of a folder's. Classic files beyond ``split_bytes`` are read in ranges of about that size.

    A folder's files are captures of their own, or, ``continued``, one after another the parts of one. Where stream numbers are asked for, only a
    ``continued`` capture (of one file or many) is read in ranges; others' files are a partition each. ``test`` gets what is found of a packet
    and the dissector, and says whether it stays; beside ``names`` it looks at ``wanted``, or at anything if it gets the ``whole`` packet.
    """
    names = list(names)
    check_fields([*names, *wanted])
    spark.dataSource.register(PcapSource)
    path = qualified(spark, path)
    options: dict[str, str] = {"fields": ",".join(names), "wanted": ",".join(wanted), "whole": str(whole).lower()}
    if test is not None:
        options["test"] = base64.b64encode(cloudpickle.dumps(test)).decode()
    files = _files(path)[1]
    in_order = not _IN_ORDER.isdisjoint([*names, *wanted])
    if continued and len(files) > 1 or (continued or whole or not in_order) and any(i.size > split_bytes for i in files):
        index = _index(spark, path, split_bytes, continued)
        options["index"] = json.dumps(index)
        if len(index) > 1 and (whole or in_order):
            options |= _course(spark, path, index)
    return _source(spark, path, **options)
