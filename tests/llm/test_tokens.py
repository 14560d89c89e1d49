from pathlib import Path

import pytest
from docs import SCHEMA, empty, extra, odd, prose

from wirelake.llm import op08_tokens as t

pytestmark = pytest.mark.skipif(not Path(t.VOCABULARY).exists(), reason="the vocabulary isn't here")


def direct(text):
    import re

    if text is None:
        return None
    return len(t.encoder(t.VOCABULARY).encode_ordinary(re.sub(r"[ \t\n\x0b\f\r]+\Z", "", re.sub(r"\r\n?", "\n", text))))


def test_counts_are_those_of_the_tokenizer(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [(i, prose(r, r.randint(0, 200)) + r.choice(["", " ", "\r\nx\r", " é日本\n\n"]), "en", "a", 1) for i in range(200)]
    got = {x["doc_id"]: x["tokens"] for x in t.counted(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "cache")).collect()}
    assert got == {x[0]: direct(x[1]) for x in rows}


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    one = spark.createDataFrame([(1, "a b", "en", "a", 1), (2, "a b \r\n", "en", "a", 1), (3, "c", "en", "a", 1)], SCHEMA)
    t.counted(one, cache).collect()
    assert spark.read.parquet(cache).count() == 2  # equal after normalisation
    spark.read.parquet(cache).selectExpr("digest", "version", "tokens + 100 AS tokens").write.parquet(str(tmp_path / "marked"))
    more = one.union(spark.createDataFrame([(4, "d e", "en", "a", 1)], SCHEMA))
    got = {r["doc_id"]: r["tokens"] for r in t.counted(more, str(tmp_path / "marked")).collect()}
    assert got == {1: 102, 2: 102, 3: 101, 4: 2} and spark.read.parquet(str(tmp_path / "marked")).count() == 3
    t.counted(more, cache, pattern=r"\S+|\s+").collect()  # another version doesn't use those counts
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_odd_documents(spark, tmp_path):
    df = odd(spark)
    got = list(((r["doc_id"] is None, r["doc_id"]), r["tokens"]) for r in t.counted(extra(df), str(tmp_path / "c")).collect())
    key = repr
    assert sorted(got, key=key) == sorted((((r["doc_id"] is None, r["doc_id"]), direct(r["text"])) for r in df.collect()), key=key)
    assert t.counted(empty(spark), str(tmp_path / "e")).count() == 0


def test_the_same_counts_without_broadcasts(spark, tmp_path, monkeypatch):
    """The way that a table takes whose misses are too many to broadcast."""
    df = odd(spark)
    rows = lambda at: sorted((repr(tuple(r)) for r in t.counted(df, str(tmp_path / at)).collect()))
    want = rows("a")
    monkeypatch.setattr(t, "checked_broadcast", lambda x, *_: x)
    assert rows("b") == want and spark.read.parquet(str(tmp_path / "a")).count() == spark.read.parquet(str(tmp_path / "b")).count()
