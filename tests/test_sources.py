import json
import os
import stat
import struct
import subprocess
import sys

import pytest
from packets import DST, MIXED, MULTI, PORT, QRY, SPORT, SRC, TIME, UDP, capture, ethernet, ipv4, tcp
from pyspark.errors import PySparkException

from wirelake.errors import DissectorError, DissectorNotFoundError, FieldNotDissectedError
from wirelake.expr import FieldRef
from wirelake.ftypes import decode
from wirelake.protocols import IP, TCP
from wirelake.sources import ek_json, process
from wirelake.sources.capture import Capture, Dumped, Program, needs, with_values
from wirelake.sources.fields_text import raw_fields, read_fields_text
from wirelake.sources.pcap import read_pcap

NUMBER = FieldRef("frame.number", "FT_FRAMENUM")
ASKED = (NUMBER, SRC, PORT, QRY)
LINES = ["1\x1f10.0.0.1\x1f51234\x1e443\x1f", "2\x1f\x1f\x1f", "3\x1f10.0.0.3\x1f\x1ffoo,bar.example", "4\x1f\x1f\x1f\x1e", "5\x1f\x1f\x1fa\rb"]


def frames(df):
    return sorted(int(r[0][0]) for r in df.collect())


def test_fields_text(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes("".join(x + "\n" for x in LINES).encode() + b"6\x1f\x1f\x1f\xff\n")
    rows = sorted(tuple(map(tuple, r)) for r in read_fields_text(spark, str(tmp_path / "f.txt"), ASKED).collect())
    assert rows[:5] == [(("1",), ("10.0.0.1",), ("51234", "443"), ()), (("2",), (), (), ()), (("3",), ("10.0.0.3",), (), ("foo,bar.example",)), (("4",), (), (), ("", "")), (("5",), (), (), ("a\rb",))]
    assert rows[5][3] == ("�",)
    typed = with_values(read_fields_text(spark, str(tmp_path / "f.txt"), ASKED), ASKED).orderBy("`frame.number`").collect()
    assert typed[0][2] == [51234, 443] and typed[1][1] is None and str(decode("FT_IPv4", typed[2][1])) == "10.0.0.3"


def test_another_number_of_columns_is_an_error(spark):
    with pytest.raises(PySparkException, match="not 4 columns"):
        raw_fields(spark.createDataFrame([("1\x1f2",)], "value string"), ASKED).collect()


def test_json_lines(spark, tmp_path):
    def packet(**layers):
        return json.dumps({"timestamp": "1", "layers": layers})

    lines = [
        '{"index":{}}', packet(frame={"frame_frame_number": "1"}, ip={"ip_ip_src": "10.0.0.1"}, tcp={"tcp_tcp_port": ["51234", 443], "tcp_tcp_flags_syn": True}), "",
        packet(frame={"frame_frame_number": "2"}, dns={"Queries": {"a: type A": {"dns_dns_qry_name": ["a", ["b", None]]}}}, ip={"ip_ip_src": None}),
        packet(frame={"frame_frame_number": "3"}, other={"deep": [{"x_ip_src": "10.0.0.3"}], "dns_qry_name": {"no": "value"}}),
    ]
    (tmp_path / "e.json").write_text("\n".join(lines) + "\n")
    asked = (*ASKED, FieldRef("tcp.flags.syn", "FT_BOOLEAN"))
    got = [tuple(map(tuple, r)) for r in ek_json.read_ek_json(spark, str(tmp_path / "e.json"), asked).orderBy("`frame.number`").collect()]
    assert got == [(("1",), ("10.0.0.1",), ("51234", "443"), (), ("1",)), (("2",), (), (), ("a", "b"), ()), (("3",), ("10.0.0.3",), (), (), ())]
    for bad in ("{", '{"layers": 3}', "[]"):
        with pytest.raises(ValueError):
            ek_json.layers_of(bad)


MATRIX = [
    (SRC == "10.0.0.1", [1, 4]), (SRC != "10.0.0.1", [2, 3, 5]), (SRC.in_([("10.0.0.2", "10.0.0.9")]), [2, 3]), (SRC.present(), [1, 2, 3, 4]), (~SRC.present(), [5]), (SRC > "10.0.0.1", [2, 3]), (DST <= "10.0.0.2", [1, 2, 3]),
    (PORT == 443, [1, 2]), (PORT != 443, [3, 4, 5]), (PORT < 8080, [1, 2]), (PORT >= 52000, [3]), (PORT.in_([8080, (440, 450)]), [1, 2, 3]), (~PORT.in_([8080]), [1, 2, 4, 5]), (PORT.present(), [1, 2, 3]), (UDP == 53, [4]),
    (SPORT == 443, [2]), (SPORT != 443, [1, 3, 4, 5]), (QRY == "mixed.example", [4]), (QRY.contains("xed"), [4]), (QRY.matches("^MIXED"), [4]), (~QRY.matches("^x"), [1, 2, 3, 4, 5]),
    (TIME >= "1700000103", [4, 5]), (TIME < "1700000101", [1]), (TIME.in_([("1700000101", "1700000103")]), [2, 3]), ((PORT == 443) & (SRC == "10.0.0.1"), [1]), ((PORT == 8080) | (UDP == 53), [3, 4]), (~((PORT == 443) | UDP.present()), [3, 5]),
]


def test_capture_matrix(spark, tmp_path):
    path = capture(tmp_path / "mixed.pcap", MIXED)
    epoch = FieldRef("frame.time_epoch", "FT_ABSOLUTE_TIME")
    raw = read_pcap(spark, path, ["frame.number", "frame.time_epoch", "ip.src", "ip.dst", "tcp.port", "tcp.srcport", "udp.port", "dns.qry.name"]).cache()
    assert [r[0] for r in raw.select("`frame.time_epoch`").orderBy("`frame.time_epoch`").collect()][1] == ["1700000101.001000000"] and epoch.name in raw.columns
    renamed = raw.withColumnRenamed("frame.time_epoch", "frame.time")
    from wirelake.sources.capture import filter_raw

    for e, want in MATRIX:
        assert frames(filter_raw(renamed, [e]).select("`frame.number`")) == want, e


def test_several_questions(spark, tmp_path):
    path = capture(tmp_path / "multi.pcap", MULTI)
    c = Capture(spark, path)
    for e, want in [(QRY == "beta.example", [1]), (QRY != "beta.example", [2, 3]), (QRY.contains("a.example"), [1, 2]), (QRY.present(), [1, 2]), (QRY.in_(["gamma.example", "x"]), [2]), (QRY > "b", [1, 2]), (FieldRef("dns.qry.type", "FT_UINT16", True) == 28, [1])]:
        assert frames(c.filter(e).raw([NUMBER])) == want, e
    assert [p["dns.qry.name"] for p in c.filter(lambda p: len(p["dns.qry.name"]) > 1).packets(NUMBER, QRY)] == [("alpha.example", "beta.example")]
    two = needs(UDP)(lambda p: p["udp.port"] == ("50002", "53") and not p.get("tcp.port"))
    assert frames(c.filter(PORT.present() | UDP.present(), two).raw([NUMBER])) == [2]
    with pytest.raises(PySparkException, match="wasn't read"):
        c.filter(needs(UDP)(lambda p: p["ip.ttl"])).raw([NUMBER]).collect()
    assert frames(c.filter(lambda p: p["ip.ttl"] == ("64",) and p["ip.proto"] == ("6",)).raw([NUMBER])) == [3]  # the whole packet
    assert c.filter(QRY == "gamma.example", lambda p: p["tcp.port"] == ()).select(NUMBER, PORT, QRY).collect()[0][2] == ["gamma.example"]


def test_unknown_fields_are_refused(spark, tmp_path):
    path = capture(tmp_path / "mixed.pcap", MIXED)
    for ask in (lambda: read_pcap(spark, path, ["ip.src", "quic.version"]), lambda: Capture(spark, path).select(FieldRef("quic.version")), lambda: Capture(spark, path).filter(FieldRef("quic.version").present()).raw([NUMBER]), lambda: Capture(spark, path).filter(~FieldRef("quic.version").present()).raw([NUMBER])):
        with pytest.raises(FieldNotDissectedError, match="quic.version"):
            ask()


def test_typed_values_of_a_whole_packet(spark, tmp_path):
    path = capture(tmp_path / "mixed.pcap", MIXED)
    got = [(p[TCP].srcport, p[TCP].port, str(p[IP].src)) for p in Capture(spark, path).packets(TCP.srcport, TCP.port, IP.src)][:2]
    assert got == [(51234, (51234, 443), "10.0.0.1"), (443, (443, 51234), "10.0.0.2")]
    seen = Capture(spark, path).filter(lambda p: p[TCP].flags_ack).raw([NUMBER])
    assert frames(seen) == [2]


def hello(name):
    server = struct.pack(">HBH", len(name) + 3, 0, len(name)) + name.encode()
    extensions = struct.pack(">HH", 43, 1) + b"\x00" + struct.pack(">HH", 0, len(server)) + server
    body = b"\x03\x03" + bytes(32) + b"\x04abcd" + struct.pack(">H", 2) + b"\x13\x01" + b"\x01\x00" + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def test_upper_layers(spark, tmp_path):
    request = b"GET /x?q=1 HTTP/1.1\r\nHost: a.example\r\nUser-Agent: me\r\n\r\n"
    answer = b"HTTP/1.1 404 Not Found\r\nContent-Length: 0\r\n\r\n"
    echo = ipv4("10.0.0.1", "10.0.0.2", 1, struct.pack(">BBHHH", 8, 0, 0x1234, 7, 9))
    six = ethernet(0x86DD, struct.pack(">IHBB", 0x60000000, 8, 58, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + struct.pack(">BBHI", 128, 0, 0xABCD, 0))
    path = capture(tmp_path / "up.pcap", [tcp("10.0.0.1", 1000, "10.0.0.2", 80, 24, request), tcp("10.0.0.2", 80, "10.0.0.1", 1000, 24, answer), tcp("10.0.0.1", 1001, "10.0.0.2", 443, 24, hello("tls.example")), echo, six])
    names = ["http.host", "http.request.method", "http.request.uri", "http.response.code", "http.user_agent", "tls.handshake.extensions_server_name", "tls.record.version", "icmp.type", "icmp.seq", "icmpv6.type", "ip.checksum", "tcp.checksum", "ip.flags.df", "tcp.hdr_len"]
    rows = [{n: r[n] for n in names if r[n]} for r in read_pcap(spark, path, names).collect()]
    checks = [r.pop("ip.checksum", None) for r in rows]
    tails = [{k: r.pop(k, None) for k in ("ip.flags.df", "tcp.hdr_len", "tcp.checksum")} for r in rows]
    assert rows == [
        {"http.host": ["a.example"], "http.request.method": ["GET"], "http.request.uri": ["/x?q=1"], "http.user_agent": ["me"]}, {"http.response.code": ["404"]},
        {"tls.handshake.extensions_server_name": ["tls.example"], "tls.record.version": ["0x0301"]}, {"icmp.type": ["8"], "icmp.seq": ["9"]}, {"icmpv6.type": ["128"]},
    ]
    assert all(c and c[0].startswith("0x") for c in checks[:4]) and checks[4] is None
    assert tails[0] == {"ip.flags.df": ["0"], "tcp.hdr_len": ["20"], "tcp.checksum": ["0x0000"]}


def test_streams_opened_again_and_relative_numbers(spark, tmp_path):
    def segment(seq, ack, flags, back=False):
        a, b = ("10.0.0.2", 80), ("10.0.0.1", 1000)
        (src, sport), (dst, dport) = (a, b) if back else (b, a)
        return ipv4(src, dst, 6, struct.pack(">HHIIHHHH", sport, dport, seq, ack, 5 << 12 | flags, 1, 0, 0))

    path = capture(tmp_path / "s.pcap", [segment(100, 0, 2), segment(900, 101, 18, True), segment(101, 901, 16), segment(100, 0, 2), segment(5000, 0, 2), segment(70, 5001, 18, True)])
    rows = read_pcap(spark, path, ["tcp.stream", "tcp.seq", "tcp.ack", "tcp.seq_raw"]).collect()
    assert [tuple(x[0] for x in r) for r in rows] == [("0", "0", "0", "100"), ("0", "0", "1", "900"), ("0", "1", "1", "101"), ("0", "0", "0", "100"), ("1", "0", "0", "5000"), ("1", "0", "1", "70")]


@pytest.mark.parametrize("split", [1, 300, 1_000_000])
def test_large_files_are_read_in_ranges(spark, tmp_path, split):
    (tmp_path / "d").mkdir()
    frames_of = [tcp("10.0.0.1", 1000 + i, "10.0.0.2", 80, 24, bytes(i * 7 % 400)) for i in range(60)]
    capture(tmp_path / "d" / "a.pcap", frames_of)
    with open(capture(tmp_path / "d" / "b.pcap", MIXED), "ab") as f:
        f.write(struct.pack("<IIII", 1, 0, 10, 10) + b"1234")  # a cut-off packet
    (tmp_path / "d" / "c.pcapng").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + bytes(0))
    names = ["frame.number", "frame.time_epoch", "frame.time_relative", "frame.time_delta", "tcp.srcport", "tcp.len"]
    df = read_pcap(spark, str(tmp_path / "d"), names, split)
    want = read_pcap(spark, str(tmp_path / "d"), names, 1 << 30)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, want.collect())) and want.count() == 65
    assert (df.rdd.getNumPartitions() > 3) == (split < 1_000_000)
    ordered = read_pcap(spark, str(tmp_path / "d"), ["tcp.stream", "tcp.srcport"], split)
    assert ordered.rdd.getNumPartitions() == 3 and sorted(int(r[0][0]) for r in ordered.collect() if r[0])[-1] == 59


def block(kind, body, end="<"):
    body += bytes(-len(body) % 4)
    return struct.pack(end + "II", kind, len(body) + 12) + body + struct.pack(end + "I", len(body) + 12)


@pytest.mark.parametrize("end", ["<", ">"])
def test_pcapng(spark, tmp_path, end):
    section = block(0x0A0D0D0A, struct.pack(end + "IHHq", 0x1A2B3C4D, 1, 0, -1), end)
    nano = struct.pack(end + "HH", 9, 1) + b"\x09\0\0\0" + struct.pack(end + "HH", 0, 0)
    interfaces = block(1, struct.pack(end + "HHI", 1, 0, 0), end) + block(1, struct.pack(end + "HHI", 1, 0, 0) + nano, end)
    packet = lambda which, ticks, data: block(6, struct.pack(end + "IIIII", which, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data, end)
    path = tmp_path / "a.pcapng"
    path.write_bytes(section + interfaces + packet(0, 1_700_000_100_000_007, MIXED[0]) + block(5, bytes(12), end) + packet(1, 1_700_000_101_000_008_000, MIXED[1]) + block(3, struct.pack(end + "I", len(MIXED[3])) + MIXED[3], end) + packet(0, 1, MIXED[2])[:-9])
    rows = read_pcap(spark, str(path), ["frame.number", "frame.time_epoch", "tcp.port", "dns.qry.name"]).collect()
    assert [tuple(map(tuple, r)) for r in rows] == [(("1",), ("1700000100.000007000",), ("51234", "443"), ()), (("2",), ("1700000101.000008000",), ("443", "51234"), ()), (("3",), ("0.000000000",), (), ("mixed.example",))]
    (tmp_path / "bad.pcapng").write_bytes(section + packet(3, 1, MIXED[0]))
    with pytest.raises(PySparkException, match="interface 3"):
        read_pcap(spark, str(tmp_path / "bad.pcapng"), ["frame.number"]).collect()


def test_odd_captures(spark, tmp_path):
    (tmp_path / "d").mkdir()
    assert read_pcap(spark, str(tmp_path / "d"), ["frame.number"]).count() == 0
    p = capture(tmp_path / "d" / "a.pcap", [tcp("10.0.0.1", 1, "10.0.0.2", 2), b"", b"\0" * 14, MIXED[0][:20]])
    with open(p, "ab") as f:
        f.write(struct.pack("<IIII", 1, 0, 10, 10) + b"1234")  # a cut-off packet
    capture(tmp_path / "d" / "b.pcap", [])
    rows = read_pcap(spark, str(tmp_path / "d"), ["frame.number", "tcp.port", "frame.len"]).collect()
    assert sorted((r[0][0], len(r[1])) for r in rows) == [("1", 2), ("2", 0), ("3", 0), ("4", 0)]
    (tmp_path / "bad").write_bytes(b"x" * 30)
    with pytest.raises(PySparkException):
        read_pcap(spark, str(tmp_path / "bad"), ["frame.number"]).collect()


def program(tmp_path, body):
    p = tmp_path / "dissector"
    p.write_text(f"#!{sys.executable}\nimport sys\n{body}")
    p.chmod(p.stat().st_mode | stat.S_IEXEC)
    return str(p)


def test_dissector_program(spark, tmp_path):
    tool = program(tmp_path, "if '--version' in sys.argv: print('Dissector 4.6.6'); sys.exit()\nprint(open(sys.argv[2]).read(), end='')\nsys.stderr.write(' '.join(sys.argv))\n")
    (tmp_path / "c").write_text("".join(x + "\n" for x in LINES[:3]))
    c = Capture(spark, str(tmp_path / "c"), Program(tool))
    assert frames(c.raw(ASKED)) == [1, 2, 3] and Program(tool).version() == "Dissector 4.6.6"
    argv = Program(tool).command("c", "ip", ASKED)
    assert argv[1:6] == ["-r", "c", "-Y", "ip", "-T"] and argv[6] == "fields" and argv.count("-e") == 4 and "occurrence=a" in argv


def test_dissector_failures(spark, tmp_path):
    bad = program(tmp_path, "print('1')\nsys.stderr.write('boom')\nsys.exit(3)\n")
    with pytest.raises(DissectorError, match="boom"):
        list(process.lines([bad]))
    with pytest.raises(PySparkException, match="boom"):
        Capture(spark, "x", Program(bad)).raw([NUMBER]).collect()
    stream = process.lines([bad])
    next(stream)
    stream.close()  # an early stop is no failure
    with pytest.raises(DissectorNotFoundError):
        list(process.lines([str(tmp_path / "none")]))
    with pytest.raises(DissectorNotFoundError):
        process.version(str(tmp_path / "none"))
    slow = program(tmp_path, "import time\nprint('1', flush=True)\ntime.sleep(60)\n")
    stream = process.lines([slow], patience=0.5)
    next(stream)
    stream.close()
    assert str(tmp_path) not in subprocess.run(["ps", "-eo", "args"], capture_output=True, text=True).stdout


def test_dumped_text_is_filtered_in_spark(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i, x in enumerate(LINES):
        (tmp_path / "t" / f"{i}.txt").write_bytes((x + "\n").encode())
    c = Capture(spark, "any", Dumped(str(tmp_path / "t"), ASKED))
    assert frames(c.filter(SRC.present()).raw([NUMBER])) == [1, 3] and frames(c.filter(PORT == 443, QRY != "x").raw([NUMBER, SRC])) == [1]
    assert os.environ.get("TSHARK") or process.program() == "tshark"
