import gzip
import io
import random

import pytest

from wirelake.llm import op09_warc as w

SCHEMA = "page_id long, url string, html string"


def member(i, payload, kind="resource", uri="https://a.example/"):
    return w.warc_member(kind, uri, payload, f"id-{i}", "2024-01-01T00:00:00Z", {"X-Page-Id": str(i)}, "text/html")


class Memory:
    def __init__(self, data):
        self.f = io.BytesIO(data)

    def seek(self, n):
        self.f.seek(n)

    def read(self, n):
        return self.f.read(n)


def all_records(data, split, block=64):
    window = w._Window(Memory(data), len(data))
    return [r for a in range(0, len(data), split) for r in w.records(window, a, min(a + split, len(data)), block)]


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_every_split_gives_the_same(split):
    r = random.Random(1)
    bodies = [bytes(r.choices(range(256), k=r.randint(0, 300))) + (w.MAGIC * 3 if i % 3 == 0 else b"") for i in range(12)]
    data = b"".join(member(i, b) for i, b in enumerate(bodies))
    got = all_records(data, split)
    assert [p for *_, p in got] == bodies and [h["x-page-id"] for _, _, h, _ in got] == [str(i) for i in range(12)]
    # the whole file decompressed is the records in order
    assert gzip.decompress(data).count(b"WARC/1.0\r\n") == 12


@pytest.mark.parametrize("split", [1, 50, 1 << 20])
def test_members_of_several_records(split):
    raw = [gzip.decompress(member(i, bytes([65 + i]) * (i * 40))) for i in range(5)]
    data = gzip.compress(b"".join(raw[:3])) + gzip.compress(raw[3]) + gzip.compress(raw[4])
    got = all_records(data, split)
    assert [(h["x-page-id"], p, n) for _, n, h, p in got] == [(str(i), bytes([65 + i]) * (i * 40), i if i < 3 else 0) for i in range(5)]
    assert len({at for at, *_ in got}) == 3
    damaged = bytearray(gzip.compress(b"".join(raw[:3]), 0))
    damaged[damaged.find(b"C" * 40) + 5] ^= 1  # in the last of three: the checksum fails
    got = [h["x-page-id"] for _, _, h, _ in all_records(bytes(damaged) + gzip.compress(raw[4]), split)]
    assert got[-1] == "4" and "2" not in got


@pytest.mark.parametrize("split", [13, 1 << 20])
def test_damage_is_passed_over(split):
    good = [member(i, b"x" * 50) for i in range(4)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    other = gzip.compress(b"no record at all")
    data = good[0] + bytes(broken) + b"junk" + w.MAGIC + b"\0" * 9 + other + good[2] + good[3][:-5]
    assert [h["x-page-id"] for _, _, h, _ in all_records(data, split)] == ["0", "2"]


def test_headers():
    text = b"WARC/1.0\r\nWARC-Type: a\r\nX: one\r\n two\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert w.parse_record(text) == ({"warc-type": "a", "x": "one two", "content-length": "3"}, b"abc")
    for bad in (b"HTTP/1.1", b"WARC/1.0\r\nX: y\r\n", b"WARC/1.0\r\nX: y\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.0\r\nContent-Length: -1\r\n\r\n"):
        assert w.parse_record(bad) is None


def test_round_trip(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"https://a.example/{i}", "".join(r.choices("<p>aé日\n", k=r.randint(0, 3_000)))) for i in range(150)]
    rows += [(None, None, None), (1000, "https://b.example/\r\nx", ""), (1001, "https://b.example/", None), (1001, "https://b.example/", None), (1002, "u", "x" * 3_000_000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", offset int").repartition(3)
    w.write_warc(df, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*.warc.gz"))) == 3
    want = sorted(((i, u and u.replace("\r", "%0D").replace("\n", "%0A"), h) for i, u, h in rows), key=repr)
    for split in (2_000, 1 << 25):
        got = w.pages_of(w.read_warc(spark, str(tmp_path / "w"), split))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    w.write_warc(df.limit(0), str(tmp_path / "e"))
    assert w.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_a_folder_of_nothing(spark, tmp_path):
    (tmp_path / "n").mkdir()
    assert w.read_warc(spark, str(tmp_path / "n")).count() == 0
    (tmp_path / "n" / "a.gz").write_bytes(b"")
    assert w.read_warc(spark, str(tmp_path / "n")).count() == 0
