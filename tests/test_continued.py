"""Captures in several files and ranges: frames and streams are numbered as in one file that one task reads; predicates run where packets are dissected."""

import random
import struct

import pytest
from packets import capture, ipv4, tcp, udp
from pyspark.errors import PySparkException

from wirelake import capture_queries
from wirelake.expr import FieldRef
from wirelake.protocols import TCP
from wirelake.sources.capture import BuiltIn, Capture, needs
from wirelake.sources.pcap import FIELDS, Dissector, packets, read_pcap

NUMBER = FieldRef("frame.number", "FT_FRAMENUM")
NAMES = ["frame.number", "frame.time_epoch", "frame.time_relative", "frame.time_delta", "tcp.stream", "udp.stream", "tcp.seq", "tcp.ack", "tcp.srcport"]


def traffic(n=400, seed=5):
    """Few ends that open, open again with other and with the same numbers, answer and end, some of them cut off."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        (src, sport), (dst, dport) = r.sample([("10.0.0.1", 1), ("10.0.0.2", 2), ("10.0.0.2", 3)], 2) if r.random() < 0.95 else [("10.0.0.1", 1)] * 2
        if r.random() < 0.2:
            out.append(udp(src, sport, dst, dport, b"x" * r.randrange(9)))
        else:
            segment = struct.pack(">HHIIHHHH", sport, dport, r.choice([5, 5, 9, 2**32 - 1]), r.randrange(20), 5 << 12 | r.choice([2, 2, 18, 16, 16, 24]), 1, 0, 0)
            out.append(ipv4(src, dst, 6, segment[: r.choice([20] * 9 + [10])]))
    return out


def rows(df):
    return sorted((tuple(tuple(x) for x in r) for r in df.collect()), key=lambda r: int(r[0][0]))


@pytest.mark.parametrize(("files", "split"), [(1, 400), (3, 700), (7, 1 << 30)])
def test_continued_files_number_as_one_file(spark, tmp_path, files, split):
    all_of = traffic()
    one = capture(tmp_path / "one.pcap", all_of)
    d = Dissector(NAMES)
    with open(one, "rb") as f:
        want = [tuple(tuple(d_.get(n, ())) for n in NAMES) for d_ in (d.fields(*p) for p in packets(f))]
    (tmp_path / "many").mkdir()
    size = -(-len(all_of) // files)
    for i in range(files):
        capture(tmp_path / "many" / f"{i}.pcap", all_of[i * size : (i + 1) * size])
    capture(tmp_path / "many" / "5a.pcap", [])
    for i in range(files):  # the times go on, too
        p = tmp_path / "many" / f"{i}.pcap"
        with open(one, "rb") as f:
            head, body = f.read(24), f.read()
        records, at = [], 0
        while at < len(body):
            n = 16 + struct.unpack("<I", body[at + 8 : at + 12])[0]
            records.append(body[at : at + n])
            at += n
        p.write_bytes(head + b"".join(records[i * size : (i + 1) * size]))
    df = read_pcap(spark, str(tmp_path / "many"), NAMES, split, continued=True)
    assert rows(df) == want and df.rdd.getNumPartitions() > min(files, 3)
    assert max(int(r[4][0]) for r in want if r[4]) > 20


def test_predicates_run_where_packets_are_dissected(spark, tmp_path):
    many = [tcp("10.0.0.1", 1000 + i % 50, "10.0.0.2", 80, 24, bytes(i % 9)) for i in range(300)]
    path = capture(tmp_path / "a.pcap", many)
    odd = Capture(spark, path).filter(TCP.port == 80, lambda p: p[TCP].srcport % 2 == 1, needs(FieldRef("frame.len"))(lambda p: int(p["frame.len"][0]) > 60)).raw([NUMBER])
    assert sorted(int(r[0][0]) for r in odd.collect()) == [i + 1 for i in range(300) if i % 2 and i % 9 > 6]
    # only the asked field leaves the dissector: the plan has no Python function over all fields
    plan = odd._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "http.host" not in plan
    whole = Capture(spark, path).filter(lambda p: len(p) == len(FIELDS) and "dns.a" in p and p["tcp.stream"] == ("7",) and dict(p)["ip.ttl"] == ("64",)).raw([NUMBER])
    assert whole.count() == 6
    kept: list = []
    late = Capture(spark, path).filter(lambda p: kept.append(p) or len(kept) > 1 and kept[0]["dns.id"] == ()).raw([NUMBER])
    with pytest.raises(PySparkException, match="packet that is over"):
        late.collect()


def test_a_capture_of_events_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """More users than an address has room for, in several files."""
    spark.range(3000).selectExpr("id * 7 AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN 65543 ELSE id END AS user_id", "CASE WHEN id % 2 = 0 THEN 'click' ELSE 'error' END AS event_type", "1.0D AS value", "'{\"k\": 12}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(capture_queries, "PACKETS", 500)
    path = capture_queries.capture_of_events(spark, str(tmp_path))
    got = Capture(spark, path, BuiltIn(continued=True)).select(NUMBER)
    assert got.rdd.getNumPartitions() > 1 and sorted(r[0] for r in got.collect()) == list(range(1, 3001))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("snk_rows", "ws_build_streams", "jon_stream_joinback", "udf_opaque_predicate"):
        query, sql = capture_queries.PAIRS[name]
        df = query(spark, str(tmp_path))
        want = sorted(map(repr, con.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()))
        assert sorted(repr(tuple(r)) for r in df.collect()) == want and want, name


def test_findings_of_a_table_are_numbered_in_order(spark, tmp_path):
    from wirelake.workspace import Workspace

    ws = Workspace(spark, str(tmp_path / "ws"), "rw")
    ws.add_annotation("packet", 1, "first")
    rows = spark.range(0, 5000, 1, 9).selectExpr("'packet' AS scope", "(id * 7919) % 5000 AS target_id", "'k' AS key", "CAST(id AS STRING) AS value", "CAST(NULL AS STRING) AS protocol", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at")
    assert ws.add_annotation_rows(rows, ["target_id"]) == 5000 and ws.add_annotation("packet", 2, "last") == 5002
    assert ws.annotations().filter("key = 'k' AND annotation_id = target_id + 2").count() == 5000
    with pytest.raises(ValueError, match="no finding"):
        ws.add_annotation_rows(rows.withColumn("protocol", rows["key"]), ["target_id"])
    assert ws.add_annotation_rows(rows.limit(0), ["target_id"]) == 0 and ws.catalog.next_annotation == 5003
