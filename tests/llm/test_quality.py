import random

import numpy as np
from docs import SCHEMA, empty, extra, odd, prose, rows_of

from wirelake.llm import op02_quality as q


def brute(x):
    """Fast MCD from many random starts to convergence, reweighted once: mean, covariance and the number of vectors it rests on."""
    n, p = x.shape
    h = int(np.ceil(q.SUPPORT * n))
    r = np.random.default_rng(1)
    factor, best = q.consistency(q.SUPPORT, p), None
    for _ in range(30):
        at = r.choice(n, 20, replace=False)
        m, c = x[at].mean(0), np.cov(x[at].T, bias=True) + np.eye(p) * q.FLOOR**2
        for _ in range(30):
            at = np.argsort(d2(x, m, c))[:h]
            m, c = x[at].mean(0), np.cov(x[at].T, bias=True) * factor + np.eye(p) * q.FLOOR**2
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = np.linalg.slogdet(c)[1], m, c
    at = d2(x, *best[1:]) <= q.chi2_quantile(0.025, p)
    return x[at].mean(0), np.cov(x[at].T, bias=True) * q.consistency(0.975, p) + np.eye(p) * q.FLOOR**2, at.sum()


def d2(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def pooled(*levels):
    """From all documents' estimate to the group's."""
    mean, cov = np.array(q._USUAL), np.eye(len(q.STATS)) * q._USUAL_SD**2
    for m, c, n in levels:
        mean, cov = (n * m + q.WEIGHT * mean) / (n + q.WEIGHT), (n * c + q.WEIGHT * cov) / (n + q.WEIGHT)
    return mean, cov


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(500):
        text = prose(r, r.randint(8, 400))
        kind = i % 20
        if kind == 0:
            text = " ".join([r.choice(["buy", "now"])] * 200)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 2:
            text = " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text.split())
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
    return rows


def test_rejects_what_brute_force_rejects(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in q.scored(spark.createDataFrame(rows, SCHEMA)).collect()}
    cut = np.sqrt(q.chi2_quantile(q.ALPHA, len(q.STATS)))
    import pyarrow as pa

    everything = brute(q.text_statistics(pa.array([r[1] for r in rows])))
    for s in ("s0", "s1"):
        own = [r for r in rows if r[3] == s]
        x = q.text_statistics(pa.array([r[1] for r in own]))
        d = np.sqrt(d2(x, *pooled(everything, everything, brute(x))))
        mine = np.array([got[r[0]]["distance"] for r in own])
        assert {r[0] for r, x in zip(own, d) if x > cut} == {r[0] for r in own if got[r[0]]["rejected"]}
        clean = d < cut
        assert np.corrcoef(d[clean], mine[clean])[0, 1] > 0.99
    rejected = {i for i, r in got.items() if r["rejected"]}
    assert not {i for i in rejected if i % 20 > 2}  # clean documents stay
    assert len(rejected) >= 0.9 * 75


def test_groups_of_any_size(spark):
    """Groups of 20 documents, and a table of 20: junk goes and clean documents stay by the same rule."""
    rows = [(i, t, "en" if i % 4 else "de", f"s{i % 25}", n) for i, t, _, _, n in corpus()]
    r = random.Random(4)
    few = [(i, prose(r, r.randint(8, 300)), "en", "a", 1) for i in range(20)] + [(20, "buy now " * 200, "en", "a", 1), (21, " ".join(w + "###" for w in prose(r, 150).split()), "en", "a", 1)]
    for table, junk in ((rows, lambda i: i % 20 < 3), (few, lambda i: i >= 20)):
        rejected = {x["doc_id"] for x in q.scored(spark.createDataFrame(table, SCHEMA)).filter("rejected").collect()}
        assert not {i for i in rejected if not junk(i)} and len(rejected) >= 0.85 * sum(junk(x[0]) for x in table)


def test_statistics_of_whole_texts():
    import pyarrow as pa

    short = q.text_statistics(pa.array(["ab cd " * 10]))
    long = q.text_statistics(pa.array(["ab cd " * 400_000 + "! " * 400_000, "ab cd " * 400_000]))
    assert long[0, 1] > long[1, 1] and not np.isnan(long).any() and not np.isnan(short).any()
    assert np.isnan(q.text_statistics(pa.array([None, "", "...", "\n"]))).all()


def test_odd_documents(spark):
    df = odd(spark)
    got = q.scored(extra(df))
    rows = got.collect()
    gone = {5, 10, 11, 14}  # signs only, 130 words 60,000 times, one word of 50,000 letters, one word 5,000 times
    assert len(rows) == df.count() and {r["doc_id"] for r in rows if r["rejected"]} == gone
    assert rows_of(q.kept(extra(df))) == [r for r in rows_of(extra(df)) if r[0] not in gone] and q.kept(extra(df)).columns == extra(df).columns
    assert q.scored(empty(spark)).count() == 0 and q.kept(empty(spark)).count() == 0
    mixed = odd(spark).union(spark.createDataFrame(corpus(), SCHEMA).withColumn("doc_id", __import__("pyspark").sql.functions.expr("CASE WHEN doc_id = 0 THEN NULL ELSE doc_id + 100 END")))
    kept = q.kept(mixed)
    bad = q.scored(mixed).filter("rejected")
    assert kept.count() == mixed.count() - bad.count() and bad.filter("doc_id IS NULL").count() == 1
    assert rows_of(q.kept(mixed, max_broadcast=0)) == rows_of(kept)  # the way that large tables take
    same = spark.createDataFrame([(i, "the same text again", "en", "s", 1) for i in range(150)], SCHEMA)
    assert q.scored(same).filter("rejected").count() == 0  # no spread at all


def test_much_junk_of_one_kind(spark):
    r = random.Random(11)
    spoil = {"symbols": lambda w: w + r.choice(["###", "$$$", "%%%"]), "capitals": lambda w: w.upper() + "!!", "pipes": lambda w: f"| {w} |"}
    rows = []
    for source, f in spoil.items():
        for i in range(400):
            words = prose(r, r.randint(40, 400)).split()
            rows.append((len(rows), " ".join(map(f, words) if i % 20 < 9 else words), "en", source, i % 20))
    rejected = {x["doc_id"] for x in q.scored(spark.createDataFrame(rows, SCHEMA)).filter("rejected").collect()}
    assert rejected == {x[0] for x in rows if x[4] < 9}
