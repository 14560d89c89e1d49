"""Packets and captures that the tests share."""

import socket
import struct

from wirelake.expr import FieldRef

SRC, DST = FieldRef("ip.src", "FT_IPv4"), FieldRef("ip.dst", "FT_IPv4")
PORT, UDP = FieldRef("tcp.port", "FT_UINT16", True), FieldRef("udp.port", "FT_UINT16", True)
SPORT = FieldRef("tcp.srcport", "FT_UINT16")
TTL = FieldRef("ip.ttl", "FT_UINT8")
HOST = FieldRef("http.host")
QRY = FieldRef("dns.qry.name", "FT_STRING", True)
TIME = FieldRef("frame.time", "FT_ABSOLUTE_TIME")
PAYLOAD = FieldRef("tcp.payload", "FT_BYTES")
LOAD = FieldRef("sys.load", "FT_DOUBLE")
LOADS = FieldRef("sys.loads", "FT_DOUBLE", True)
SIX = FieldRef("ipv6.src", "FT_IPv6")
SYN = FieldRef("tcp.flags.syn", "FT_BOOLEAN")
RTT = FieldRef("tcp.rtt", "FT_RELATIVE_TIME")


def raw_frame(spark, rows, refs):
    """Rows of raw occurrences as a table; ``i`` numbers them."""
    schema = "i long, " + ", ".join(f"`{r.name}` array<string>" for r in refs)
    return spark.createDataFrame([(i, *[list(p.get(r.name, ())) for r in refs]) for i, p in enumerate(rows)], schema)


def _sum(data):
    data += b"\0" * (len(data) % 2)
    s = sum(struct.unpack(f">{len(data) // 2}H", data))
    s = (s & 0xFFFF) + (s >> 16)
    return ~(s + (s >> 16)) & 0xFFFF


def ethernet(kind, body):
    return bytes.fromhex("020000000002020000000001") + struct.pack(">H", kind) + body


def ipv4(src, dst, proto, body):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0) + socket.inet_aton(src) + socket.inet_aton(dst)
    return ethernet(0x0800, head[:10] + struct.pack(">H", _sum(head)) + head[12:] + body)


def tcp(src, sport, dst, dport, flags=2, body=b""):
    return ipv4(src, dst, 6, struct.pack(">HHIIHHHH", sport, dport, 1, 0, 5 << 12 | flags, 8192, 0, 0) + body)


def udp(src, sport, dst, dport, body=b""):
    return ipv4(src, dst, 17, struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body)


def dns(*questions):
    out = struct.pack(">HHHHHH", 0x1234, 0x0100, len(questions), 0, 0, 0)
    for name, kind in questions:
        out += b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">HH", kind, 1)
    return out


def arp():
    return ethernet(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + bytes(6) + socket.inet_aton("10.0.0.1") + bytes(6) + socket.inet_aton("10.0.0.2"))


def capture(path, frames, start=1_700_000_100):
    """A classic capture file of (bytes) with a second and a millisecond more each."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, data in enumerate(frames):
            f.write(struct.pack("<IIII", start + i, i * 1000, len(data), len(data)) + data)
    return str(path)


MIXED = [tcp("10.0.0.1", 51234, "10.0.0.2", 443), tcp("10.0.0.2", 443, "10.0.0.1", 51234, 18), tcp("10.0.0.3", 52000, "10.0.0.2", 8080), udp("10.0.0.1", 53534, "10.0.0.9", 53, dns(("mixed.example", 1))), arp()]
MULTI = [udp("10.0.1.1", 50001, "10.0.1.53", 53, dns(("alpha.example", 1), ("beta.example", 28))), udp("10.0.1.2", 50002, "10.0.1.53", 53, dns(("gamma.example", 1))), tcp("10.0.1.1", 40000, "10.0.1.53", 80)]
