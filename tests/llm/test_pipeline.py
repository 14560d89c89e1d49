"""The pipeline against stages by brute force, in plain Python, none of which calls the operators' own search."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
import test_minhash
import test_mixing
import test_quality
import test_secrets
from docs import SCHEMA, empty, extra, odd, prose

from wirelake.llm import op02_quality, op04_packing
from wirelake.llm.op08_tokens import VOCABULARY, encoder
from wirelake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Clean documents, junk, exact and near copies, secrets."""
    r = random.Random(21)
    rows = []
    for i in range(360):
        text = prose(r, r.randint(30, 300))
        if i % 20 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 20 == 1:
            text = " ".join(["buy", "now"] * 100)
        elif i % 20 == 2:
            text += f' password = "{r.getrandbits(120):030x}" ' + prose(r, 20)
        rows.append((i, text, ("en", "de")[i % 2], ("a", "a", "b")[i % 3], len(text)))
        if i % 6 == 5:
            words = text.split()
            words[len(words) // 2] = "altered"
            copy = text if i % 12 == 5 else " ".join(words)
            rows.append((1000 + i, copy, *rows[-1][2:]))
    return rows


def by_hand(rows):
    """Each stage's rows."""
    x = op02_quality.text_statistics(pa.array([r[1] for r in rows]))
    of = lambda pick: test_quality.brute(x[[i for i, r in enumerate(rows) if pick(r)]])
    whole, good = of(lambda r: True), []
    for lang, source in sorted({r[2:4] for r in rows}):
        m, c = test_quality.pooled(whole, of(lambda r: r[2] == lang), of(lambda r: r[2:4] == (lang, source)))
        good += [r for r, d in zip(rows, test_quality.d2(x, m, c)) if r[2:4] == (lang, source) and d <= op02_quality.chi2_quantile(op02_quality.ALPHA, len(op02_quality.STATS))]
    gone = {i for g in test_minhash.brute(good) for i in g[1:]}
    one = [r for r in good if r[0] not in gone]
    clean = []
    for r in one:
        text = r[1]
        for name, a, b, _ in reversed(test_secrets.brute(text)):
            text = text[:a] + f"<{name.upper()}>" + text[b:]
        clean.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text)))
    copies = test_mixing.brute(clean)
    mixed = [r for r in clean for _ in range(copies.get(r[0], 0))]
    return good, one, clean, mixed


def test_every_operator_has_a_query():
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries() if k.startswith("op"))
    assert numbers == list(range(1, 11)) and set(oracle_sql()) <= set(queries())


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    wanted = by_hand(rows)
    good, one, clean, mixed = wanted
    assert len(rows) > len(good) > len(one) and one != clean and clean != mixed  # every stage does something
    for i, ((_, stage), want) in enumerate(zip(corpus_pipeline.STAGES, wanted)):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == FIELDS and sorted(map(tuple, docs.collect())) == sorted(want)
    enc = encoder(VOCABULARY)
    n = Counter()
    for r in wanted[-1]:
        n[r[0]] += len(enc.encode_ordinary(r[1].rstrip()))
    got, bins = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["length"]
        bins[r["bin"]].append((r["position"], r["length"]))
    assert got == n
    for places in bins.values():
        ends = np.cumsum([k for _, k in sorted(places)])
        assert [p for p, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= op04_packing.CAPACITY
    assert len(bins) <= 1.05 * sum(n.values()) / op04_packing.CAPACITY + 1


def test_odd_documents(spark):
    for df in (extra(odd(spark)), empty(spark), spark.createDataFrame([(None, None, None, None, None)], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= df.count()
