import math
import random

import duckdb
import pytest
from docs import SCHEMA, empty, extra, odd, prose, rows_of

from wirelake.llm.license_texts import TEMPLATES
from wirelake.llm.op01_license import license_spans, oracle, template_words


def common(a, b):
    """The longest common subsequence's length, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def brute(rows, templates, gram=3, band=3, share=0.8, strong=0.1, gap=0.25):
    """The same definition over plain lists."""
    found = []
    for doc_id, text in {(r[0], r[1]) for r in rows if r[1] is not None}:
        words = template_words(text)
        for name, template in templates:
            t = template_words(template)
            if len(t) < gram:
                continue
            at = {}
            for p in range(len(t) - gram + 1):
                at.setdefault(tuple(t[p : p + gram]), []).append(p)
            votes = {}
            for p in range(len(words) - gram + 1):
                for q in at.get(tuple(words[p : p + gram]), ()):
                    votes.setdefault(p - q, set()).add(p)
            islands = []
            for d in sorted(votes):
                first, last = min(votes[d]), max(votes[d]) + gram
                if islands and d - islands[-1]["high"] <= band and abs(first - islands[-1]["first"]) <= 2 * len(t):
                    x = islands[-1]
                    x |= {"high": d, "first": first, "start": min(x["start"], first), "end": max(x["end"], last), "votes": x["votes"] + len(votes[d])}
                else:
                    islands.append({"low": d, "high": d, "first": first, "start": first, "end": last, "votes": len(votes[d])})
            chains = []
            for x in sorted((x for x in islands if x["votes"] >= strong * len(t)), key=lambda x: (x["low"], x["start"])):
                if chains and x["low"] - chains[-1]["last"]["high"] <= gap * len(t) and abs(x["start"] - chains[-1]["last"]["start"]) <= 2 * len(t):
                    y = chains[-1]
                    y |= {"last": x, "high": max(y["high"], x["high"]), "start": min(y["start"], x["start"]), "end": max(y["end"], x["end"]), "votes": y["votes"] + x["votes"]}
                else:
                    chains.append(x | {"last": x})
            for x in chains:
                span, wide = words[max(x["low"], 0) : x["high"] + len(t)], math.ceil(len(t) * (1 + gap))
                n = max(common(t, span[k : k + wide]) for k in range(max(1, len(span) - wide + 1)))
                if n / len(t) >= share:
                    found.append((doc_id, name, x["start"], x["end"], x["votes"], n, n / len(t)))
    return sorted(found, key=repr)


def planted(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(40):
        name, text = TEMPLATES[i % len(TEMPLATES)]
        words = text.split()
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(words))
            words[k : k + 1] = r.choice([[], ["changed"], [words[k], "inserted"]])
        rows.append((i, prose(r, r.randint(0, 60)) + "\n" + " ".join(words) + " " + prose(r, 30), "en", "s", 1))
    return rows


def test_brute_force(spark):
    rows = planted()
    got = sorted(map(tuple, license_spans(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == brute(rows, TEMPLATES) and len({g[0] for g in got}) >= 35


def test_a_phrase_more_or_less_in_the_middle(spark):
    text = dict(TEMPLATES)["bsd-2-clause"]
    words = text.split()
    k = len(words) // 2
    rows = [(1, " ".join([*words[:k], *"in this position and unchanged by anybody at all".split(), *words[k:]]), "en", "a", 1), (2, " ".join([*words[:k], *words[k + 9 :]]), "en", "a", 1)]
    got = {r["doc_id"]: r for r in license_spans(spark.createDataFrame(rows, SCHEMA)).collect() if r["license"] == "bsd-2-clause"}
    assert got[1]["similarity"] == 1.0 and 0.8 < got[2]["similarity"] < 1


def test_scattered_trigrams_are_no_licence(spark):
    r = random.Random(12)
    for name, text in TEMPLATES:
        t = template_words(text)
        if len(t) < 30:
            continue  # too short for sixty trigrams to be out of order everywhere
        at = [r.randrange(len(t) - 2) for _ in range(60)]
        rows = [(1, " ".join(" ".join(t[p : p + 3]) for p in at), "en", "a", 1)]
        assert [g for g in brute(rows, [(name, text)])] == []
        assert license_spans(spark.createDataFrame(rows, SCHEMA), templates=[(name, text)]).count() == 0


def test_sql(spark):
    rows = planted(2)
    df = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    r = con.execute(oracle())
    want = sorted(map(tuple, r.fetchall()), key=repr)
    assert [d[0] for d in r.description] == license_spans(df).columns
    assert sorted(map(tuple, license_spans(df).collect()), key=repr) == want


def test_odd_documents(spark):
    text = TEMPLATES[1][1]
    more = spark.createDataFrame([(20, text, None, None, None), (20, text, None, None, None), (20, f"Other. {text}", None, None, None), (None, text, "en", "a", 1)], SCHEMA)
    df = odd(spark).union(more)
    rows = [tuple(r) for r in df.collect()]
    got = sorted(map(tuple, license_spans(extra(df)).collect()), key=repr)
    assert got == brute(rows, TEMPLATES) and [g[0] for g in got].count(20) == 2 and [g[0] for g in got].count(None) == 1
    assert rows_of(license_spans(empty(spark))) == [] and rows_of(license_spans(df, templates=[])) == [] and rows_of(license_spans(df, templates=[("short", "two words")])) == []


@pytest.mark.parametrize("gram, share", [(4, 0.6), (2, 0.9)])
def test_parameters(spark, gram, share):
    rows = planted(3)[:20]
    got = sorted(map(tuple, license_spans(spark.createDataFrame(rows, SCHEMA), gram=gram, share=share).collect()), key=repr)
    assert got == brute(rows, TEMPLATES, gram=gram, share=share)
