import random

import duckdb
from docs import SCHEMA, empty, extra, odd, prose, rows_of

from wirelake.llm import op06_minhash as m


def words(text):
    import re

    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def shingles(text, k=m.SHINGLE):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=m.THRESHOLD):
    """Components over all pairs, by exact similarity."""
    sets = [(r, shingles(r[1])) for r in rows if r[1] is not None]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if a[1] == b[1] or x and y and len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    groups = {}
    for i, (r, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(r[0])
    return sorted(sorted(g, key=lambda x: (x is None, x)) for g in groups.values() if len(g) > 1)


def planted(n=120, seed=1):
    r = random.Random(seed)
    rows = []
    shared = prose(r, 60)
    for i in range(n):
        text = prose(r, r.randint(20, 300)) + (" " + shared if i % 10 == 0 else "")
        rows.append((i, text, "en", "a", 1))
        if i % 2 == 0:
            w = text.split()
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(["altered", "replaced", ""])
            rows.append((1000 + i, " ".join(w), "en", "a", 1))
    return rows


def groups_of(df):
    by = {}
    for r in m.near_duplicate_groups(df).collect():
        by.setdefault(r["root"], []).append(r["doc_id"])
    return sorted(sorted(g, key=lambda x: (x is None, x)) for g in by.values() if len(g) > 1)


def test_brute_force(spark):
    rows = planted()
    want = brute(rows)
    got = groups_of(spark.createDataFrame(rows, SCHEMA))
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    assert len(want) >= 50 and pairs(got) <= pairs(want) and len(pairs(got)) >= 0.95 * len(pairs(want))


def test_sql(spark):
    """The exact SQL; these documents are far from the threshold, so nothing is missed."""
    rows = [*planted(60, 5), (5000, "", "en", "a", 0), (5001, "", "en", "a", 0), (5002, "two words", "en", "a", 9), (5003, "Two, words", "en", "a", 9), (5004, None, "en", "a", 0), (5005, "ÉCOLE du nord", "fr", "a", 9), (5006, "école du nord", "fr", "a", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    r = con.execute(m.ORACLE_PAIRS)
    assert [d[0] for d in r.description] == m.duplicates(df).columns
    assert sorted(r.fetchall()) == sorted(map(tuple, m.duplicates(df).collect()))


def test_posterior_bounds():
    steps = m.fewest_matches(160, 0.5, 0.01, 16)
    assert [k for k, _ in steps] == list(range(16, 161, 16)) and all(0 < f < 0.5 * k for k, f in steps)
    assert [f for _, f in m.fewest_matches(160, 0.5, 0.2, 16)] > [f for _, f in steps]


def test_bounds_lose_few(spark):
    """Pairs at the threshold are kept at about the chosen miss probability for all batches together."""
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(1)
    n = 4_000
    same = r.random((n, 160)) < 0.55
    a = r.integers(0, 2**31, (n, 160)).astype(np.uint32)
    b = np.where(same, a, a + 1).astype(np.uint32)
    keep = m._survives(160, 0.5, 0.01, 16).func(pd.Series([x.tobytes() for x in a]), pd.Series([x.tobytes() for x in b]))
    assert keep.mean() > 0.99
    b = np.where(r.random((n, 160)) < 0.2, a, a + 1).astype(np.uint32)
    assert m._survives(160, 0.5, 0.01, 16).func(pd.Series([x.tobytes() for x in a]), pd.Series([x.tobytes() for x in b])).mean() < 0.01


def test_large_group_and_least_id(spark):
    r = random.Random(8)
    base = prose(r, 200).split()
    rows = []
    for i in range(800):
        w = list(base)
        w[r.randrange(200)] = f"v{i}"
        rows.append((5000 - i, " ".join(w), "en", "a", 1))
    got = m.duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 799 and {x["duplicate_of"] for x in got} == {5000 - 799} and {x["group_size"] for x in got} == {800}


def test_odd_documents(spark):
    df = odd(spark)
    rows = [tuple(r) for r in df.collect()]
    assert groups_of(extra(df)) == brute(rows)
    out = m.deduplicated(extra(df))
    assert out.columns == extra(df).columns
    left = [r[0] for r in rows_of(out)]
    assert left.count(None) == 1 and {x for x in left if x is not None} == {1, 2, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14} and left.count(12) == 2
    assert m.duplicates(empty(spark)).count() == 0 and m.deduplicated(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a text of a few words", "en", "a", 1)] * 3 + [(2, "something else as it were", "en", "a", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in m.deduplicated(twice).collect()) == [1, 2]


def test_the_same_rows_without_broadcasts(spark, monkeypatch):
    """The way that tables take whose keys are too many to broadcast."""
    df = spark.createDataFrame(planted(40, 4), SCHEMA)
    want, left = rows_of(m.duplicates(df)), rows_of(m.deduplicated(df))
    monkeypatch.setattr(m, "checked_broadcast", lambda x, *_: x)
    assert rows_of(m.duplicates(df)) == want and rows_of(m.deduplicated(df)) == left and want


def test_lists_of_documents_are_not_broadcast(spark, monkeypatch):
    """What is broadcast grew with the table up to a million rows, too many for a small driver."""
    df = spark.createDataFrame(planted(60, 6), SCHEMA)
    plans = []
    real = m.cut
    monkeypatch.setattr(m, "cut", lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or real(x))
    auto = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(auto)
    spark.conf.set(auto, "-1")
    try:
        got = m.duplicates(df)
        plans.append(got._jdf.queryExecution().executedPlan().toString())
        rows = rows_of(got)
    finally:
        spark.conf.set(auto, before)
    assert rows and len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_sieve_keeps_every_key(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wirelake.llm import common as c

    rows = spark.range(200_000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("x"))
    keys = c.cut(rows.filter("id % 50 = 3"))
    kept = {r["id"] for r in c.sifted(rows, keys, "id", "x").collect()}
    assert {*range(3, 200_000, 50)} <= kept and len(kept) < 4_000 + 0.03 * 200_000
    assert c.sifted(rows, keys.limit(0), "id", "x").count() == 0
    monkeypatch.setattr(c, "SIEVE_MOST", 1 << 15)
    kept = {r["id"] for r in c.sifted(rows, keys, "id", "x").collect()}
    assert {*range(3, 200_000, 50)} <= kept and len(kept) < 50_000
    docs = planted(40, 4)
    df = spark.createDataFrame(docs, SCHEMA)
    want = rows_of(m.duplicates(df))
    monkeypatch.setattr(m, "sieve", lambda *_: (F.lit(0).cast("long"), lambda places: places == 0))
    monkeypatch.setattr(m, "sifted", lambda x, *_: x)
    assert want and rows_of(m.duplicates(df)) == want


def test_one_of_each_group_stays(spark):
    rows = planted(60, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    groups = groups_of(df)
    gone = {x for g in groups for x in g[1:]}
    assert {r["doc_id"] for r in m.deduplicated(df).collect()} == {r[0] for r in rows} - gone
    assert sorted((r["doc_id"], r["duplicate_of"]) for r in m.duplicates(df).collect()) == sorted((x, g[0]) for g in groups for x in g[1:])


def test_texts_that_share_sixty_bits_of_their_key_are_two(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(m, "text_key", lambda text: F.unhex(F.concat(F.lit("0" * 16), F.substring(F.md5(text), 17, 16))))
    rows = [(1, "first text of some words", "en", "a", 1), (2, "another one it has others entirely", "en", "a", 1), (3, "another one it has others entirely", "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert groups_of(df) == [[2, 3]] and sorted(r[0] for r in m.deduplicated(df).collect()) == [1, 2]


def test_exact_join_by_prefixes(spark):
    rows = planted(80, 9)
    sets = [(i, sorted({hash(g) for g in shingles(r[1])})) for i, r in enumerate(rows)]
    got = {(r["a"], r["b"]) for r in m.exact_pairs(spark.createDataFrame(sets, "node long, set array<long>"), 0.5).collect()}
    of = [set(x) for _, x in sets]
    assert got == {(a, b) for a in range(len(of)) for b in range(a) if len(of[a] & of[b]) >= 0.5 * len(of[a] | of[b])} and len(got) > 30


def test_bands_of_unrelated_documents_make_few_pairs(spark):
    """10,000 documents that share a passage and little else meet in one bucket: the pairs compared grow with their number, and no link is lost."""
    from pyspark.sql import functions as F

    from wirelake.llm.grouping import bucket_groups

    n = 10_000
    members = spark.range(n).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"))
    seen = []

    def verify(edges):
        seen.append(edges.count())
        return edges.filter("a = b + 1 AND a % 100 = 1")

    # a set: twenty shingles of the passage, sixty of its own; of each hundred the second repeats the first's
    own = F.when(F.col("id") % 100 == 1, F.col("id") - 1).otherwise(F.col("id"))
    passage = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda x: -x.cast("long"))
    sets = spark.range(n).select(F.col("id").alias("node"), F.concat(passage, F.transform(F.sequence(F.lit(0), F.lit(59)), lambda x: own * 1000 + x)).alias("set"))
    roots = {r["node"]: r["root"] for r in bucket_groups(members, verify, lambda ids: m.exact_pairs(sets.join(ids, "node"), 0.5)).collect()}
    assert sum(seen) <= 2 * n and roots == {k: k // 100 * 100 for k in range(n) if k % 100 < 2}


def test_spark_broadcasts_little_on_its_own(spark):
    """The session's threshold is 10 MB by default, and the driver holds what is broadcast several times over."""
    from wirelake.llm import common as c

    auto = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(auto)
    with c.small_batches(spark):
        assert int(spark.conf.get(auto)) <= c.AUTO_BROADCAST
    assert spark.conf.get(auto) == before
    keys = c.cut(spark.range(100))
    with c.sieves_given_back():
        kept = c.sifted(spark.range(1000), keys, "id")
        assert c.cut(kept).count() >= 100
    assert not c._open


def test_keys_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from wirelake.llm import common as c

    monkeypatch.setattr(c, "SIEVE_BITS", 1)  # crowded bits, so that several levels are needed
    rows = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.md5(F.col("id").cast("string")).alias("x"))
    ours, others = (c.cut(rows.filter(f"coalesce(id, 0) % 3 {op} 0")) for op in ("=", "<>"))
    got = rows.filter(c.told_apart(ours, others, "id", "x")(F.col("id"), F.col("x")))
    assert got.count() == 20_000 and got.filter("coalesce(id, 0) % 3 <> 0").count() == 0
    assert rows.filter(c.told_apart(ours.limit(0), others, "id", "x")(F.col("id"), F.col("x"))).count() == 0
    monkeypatch.setattr(c, "SIEVE_MOST", 10)
    assert c.told_apart(ours, others, "id", "x") is None


def test_what_is_removed_is_not_broadcast(spark, monkeypatch):
    """Up to a million ids and keys of what goes were broadcast; joins of Spark's own choice were up to its threshold, which is 10 MB by default."""
    rows = planted(60, 6)
    df = spark.createDataFrame([*rows, (None, None, "en", "a", 1)], SCHEMA)
    plans, auto = [], "spark.sql.autoBroadcastJoinThreshold"
    real = m.cut
    monkeypatch.setattr(m, "cut", lambda x: plans.append(spark.conf.get(auto)) or real(x))
    want = rows_of(m.deduplicated(df))
    assert "Broadcast" not in m.deduplicated(df)._jdf.queryExecution().executedPlan().toString() and len(want) > 30
    monkeypatch.setattr(m, "told_apart", lambda *_: None)
    assert rows_of(m.deduplicated(df)) == want
