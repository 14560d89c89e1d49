import random
from collections import Counter

import duckdb
import pytest
from docs import SCHEMA, empty, extra, odd, rows_of

from wirelake.llm import op10_mixing as m


def corpus(n=600, seed=1):
    r = random.Random(seed)
    return [(i, "t", "en", r.choice(["a", "a", "a", "a", "b", "c", None]), r.randint(0, 5_000)) for i in range(n)]


def brute(rows, weights=None, total=None):
    """Copies by sorting each source."""
    import hashlib
    import math

    size = lambda n: 1 + math.isqrt(max(n or 0, 0))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    w = {s: math.sqrt(len(x)) if weights is None else float(weights.get(s, 0)) for s, x in by.items()}
    out = Counter()
    for s, own in by.items():
        goal = math.floor((total or len(rows)) * w[s] / sum(w.values()) + 0.5)
        x_sum = sum(size(r[4]) for r in own)
        need, ranked = goal, []
        for r in own:
            e = float(goal) * float(size(r[4])) / float(x_sum)
            whole = math.floor(e)
            need -= whole
            out[r[0]] += whole
            p = e - whole
            if p > 0:
                u = (int(hashlib.md5(f"{m.SEED}:{r[0]}:{r[4]}".encode()).hexdigest()[:12], 16) + 0.5) / 16.0**12
                ranked.append((u / (1 - u) / (p / (1 - p)), r[0]))
        for _, i in sorted(ranked)[:need]:
            out[i] += 1
    return {i: n for i, n in out.items() if n}


@pytest.mark.parametrize("params", [{}, {"weights": {"a": 1, "b": 3}, "total": 900}, {"total": 50}])
def test_brute_force(spark, params):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["copies"] for r in m.copies(df, **params).collect()}
    assert got == brute(rows, **params)
    assert Counter(r["doc_id"] for r in m.mix(df, **params).collect()) == Counter(got)


def test_sources_get_their_sizes(spark):
    rows = corpus()
    got = Counter(r["source"] for r in m.mix(spark.createDataFrame(rows, SCHEMA), weights={"a": 1, "b": 1, "c": 2}, total=1000).collect())
    assert got == {"a": 250, "b": 250, "c": 500}
    assert m.mix(spark.createDataFrame(rows, SCHEMA), weights={"none": 1.0}).count() == 0


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is drawn about as often as its fraction says."""
    rows = [(i, "t", "en", "a", (1 + i % 10) ** 2 * 100) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    n, seeds = Counter(), 40
    for seed in range(seeds):
        for r in m.copies(df, total=20, seed=seed).collect():
            n[r["doc_id"] % 10] += r["copies"]
    sizes = [1 + int((1 + k) * 10) for k in range(10)]
    for k in range(10):
        assert abs(n[k] / seeds / 6 - 20 * sizes[k] / (6 * sum(sizes))) < 0.12


def test_sql(spark):
    rows = corpus(400, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"n_chars": "int64"}))
    want = {r[0]: r[2] for r in con.execute(m.ORACLE_COPIES).fetchall()}
    assert {r["doc_id"]: r["copies"] for r in m.copies(df).collect()} == want


def test_odd_documents(spark):
    df = odd(spark)
    out = m.mix(extra(df))
    assert out.columns == extra(df).columns and set(rows_of(out)) <= set(rows_of(extra(df)))
    goals = Counter()
    n = Counter(r["source"] for r in df.collect())
    import math

    w = sum(math.sqrt(x) for x in n.values())
    for s, x in n.items():
        goals[s] = math.floor(df.count() * math.sqrt(x) / w + 0.5)
    assert Counter(r["source"] for r in out.collect()) == goals
    assert m.mix(empty(spark)).count() == 0 and m.copies(empty(spark)).count() == 0
    ties = spark.createDataFrame([(1, "x", "en", "a", 5)] * 30, SCHEMA)
    assert m.mix(ties, total=17).count() == 17
