import random
from collections import defaultdict

import pytest
from docs import SCHEMA, empty, extra, odd, prose
from pyspark.sql import functions as F

from wirelake.llm import op04_packing as p


def best_fit(sizes, capacity):
    """Bins that sequential best-fit decreasing needs."""
    gaps = []
    for n in sorted(sizes, reverse=True):
        at = min((g for g in gaps if g >= n), default=None)
        if at is None:
            gaps.append(capacity - n)
        else:
            gaps.remove(at)
            gaps.append(at - n)
    return len(gaps)


def check(rows, sizes, capacity):
    """Every token of every document in one place, no bin too full, nothing overlapping."""
    cover, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        if r["bin"] is None:
            assert r["length"] == 0 and r["position"] is None
            continue
        assert 0 < r["length"] <= capacity
        cover[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["bin"]].append((r["position"], r["length"]))
    for doc, n in sizes.items():
        at = 0
        for start, length in sorted(cover.get(doc, [])):
            assert start == at
            at += length
        assert at == n
    for places in bins.values():
        at = 0
        for position, length in sorted(places):
            assert position == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("rows_a_task", [200_000, 40])
def test_valid_and_tight(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(p, "ROWS_A_TASK", rows_a_task)
    r = random.Random(9)
    sizes = {i: r.choice([r.randint(1, 100), r.randint(1, 30), r.randint(90, 350)]) for i in range(400)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, size long")
    rows = p.pack(df, 100, F.col("size")).collect()
    assert len(rows) == sum(-(-n // 100) for n in sizes.values())
    used = check(rows, sizes, 100)
    whole = sum(n // 100 for n in sizes.values())
    assert used <= 1.03 * (whole + best_fit([n % 100 for n in sizes.values() if n % 100], 100)) + 1


def rounds(sizes, capacity):
    """The bins' contents by the rounds that ``pack`` states, without ranges: one sweep over all documents and gaps, on lists."""
    left = {i: n for i, n in enumerate(sizes) if n}
    gaps, bins = {}, defaultdict(list)
    while left:
        if not gaps or max(gaps.values()) < 1:
            at = len(bins)
            for b in range(at, at + -(-sum(left.values()) // capacity)):
                gaps[b], bins[b] = capacity, []
        most = max(left.values())
        slots = []
        for b, g in gaps.items():
            times = max(g // most, 1)
            slots += [(g // times, b * (capacity + 1) + k) for k in range(times)]
        stack, got = [], {}
        for n, kind, uid in sorted([(g, 0, u) for g, u in slots] + [(n, 1, u) for u, n in left.items()], key=lambda x: (-x[0], x[1], x[2])):
            if kind == 0:
                stack.append(uid)
            elif stack:
                got[uid] = stack.pop() // (capacity + 1)
        for i, b in got.items():
            bins[b].append(sizes[i])
            gaps[b] -= left.pop(i)
        if left:
            gaps = {b: g for b, g in gaps.items() if g >= min(left.values())}
    return sorted(sorted(x) for x in bins.values() if x)


@pytest.mark.parametrize("rows_a_task", [200_000, 30])
def test_assignment_against_brute_force(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(p, "ROWS_A_TASK", rows_a_task)
    r = random.Random(3)
    sizes = [r.choice([r.randint(1, 99), r.randint(1, 20), 0]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, size long").coalesce(1)  # so rows are numbered in this order
    bins = defaultdict(list)
    for x in p.pack(df, 100, F.col("size")).collect():
        if x["bin"] is not None:
            bins[x["bin"]].append(x["length"])
    assert sorted(sorted(x) for x in bins.values()) == rounds(sizes, 100)


def test_null_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -4), (4, 3)], "doc_id long, tok long")
    assert sorted((x["doc_id"], x["length"], x["bin"] is None) for x in p.pack(df, 8, F.col("tok")).collect()) == [(1, 5, False), (2, 0, True), (3, 0, True), (4, 3, False)]


def test_matches_across_ranges():
    left = [(0, 0, 5), (1, 3, 1), (2, 7, 0), (3, 1, 2)]
    pieces = p.across(left)
    assert sum(n for _, kind, *_, n in pieces if kind == 1) == sum(n for _, kind, *_, n in pieces if kind == 0) == 6
    assert [x for x in pieces if x[1] == 1] == [(0, 1, 1, 0, 3), (1, 1, 2, 0, 1), (2, 1, 2, 1, 2)]


def test_words_are_counted_whole(spark):
    df = spark.createDataFrame([("Ab, cd!",), ("é 1_a",), ("",), (None,), ("  ",), ("x " * 70_000,)], "text string")
    assert [r[0] for r in df.select(p.token_length()).collect()] == [4, 2, 0, 0, 0, 70_000]


def test_odd_documents(spark):
    df = odd(spark)
    rows = p.pack(extra(df), 512).collect()
    n = [r[0] for r in df.select(p.token_length()).collect()]
    assert sum(r["length"] for r in rows) == sum(n) and sum(r["bin"] is None for r in rows) == n.count(0)
    assert max(r["part"] for r in rows) == -(-max(n) // 512) - 1 and all(r["length"] <= 512 for r in rows)
    assert p.pack(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "a", 0)], SCHEMA)
    assert [(r["bin"], r["length"]) for r in p.pack(none).collect()] == [(None, 0)] * 2
    ties = spark.createDataFrame([(i, prose(random.Random(1), 50), "en", "a", 1) for i in range(60)], SCHEMA)
    size = ties.select(p.token_length()).first()[0]
    check(p.pack(ties, 3 * size).collect(), {i: size for i in range(60)}, 3 * size)
    assert len({r["bin"] for r in p.pack(ties, 3 * size).collect()}) == 20


def test_the_query_packs_tokens(spark, tmp_path):
    from wirelake.llm.op08_tokens import VOCABULARY, encoder

    texts = ["Unquestionably idiosyncratic wordings, notwithstanding!\r\n\r\nx = {'a': 1}  \n", "日本語の文章は空白がない" * 200, "two words", "", " \n", None]
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    enc = encoder(VOCABULARY)
    sizes = {i: len(enc.encode_ordinary((t or "").replace("\r\n", "\n").rstrip())) for i, t in enumerate(texts)}
    assert sizes[1] > p.CAPACITY and sizes[3] == 0
    rows = p.op4_best_fit_packing(spark, str(tmp_path)).collect()
    check(rows, sizes, p.CAPACITY)
    assert {r["doc_id"] for r in rows} == set(sizes)
