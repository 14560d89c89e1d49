"""Licence scan by diagonal voting."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from wirelake.llm.common import BROADCAST_ROWS, checked_broadcast, cut, give_back, only
from wirelake.llm.license_texts import TEMPLATES
from wirelake.llm.wordscan import grams, scan, text_bytes

#: Diagonals at most BAND apart are one island; islands with votes for STRONG of a template's words are chained over gaps of up to GAP of
#: its length; SHARE of its words must be there in order.
GRAM, BAND, SHARE, STRONG, GAP = 3, 3, 0.8, 0.1, 0.25
_WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())


def _gram_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, pos, gram): every rolling k-gram of words of every document, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for i, j, _, _, _, _, hashes, before in scan(*text_bytes(batch.column("text"))):
                g, inside = grams(hashes, before, k)
                at = np.flatnonzero(inside)
                row = np.repeat(np.arange(j - i), np.diff(before))[at] if len(at) else np.zeros(0, int)
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([ids.take(take), keys.take(take), pa.array((at - before[row]).astype(np.int32)), pa.array(g[at].view(np.int64))], ["doc_id", "text_key", "pos", "gram"])
            give_back()

    return docs.mapInArrow(run, "doc_id long, text_key long, pos int, gram long")


def in_order(words: Sequence[str], heard: Sequence[str]) -> int:
    """How many of the words are in ``heard`` in their order: the longest common subsequence, a bit for each word."""
    masks: dict[str, int] = {}
    for j, x in enumerate(words):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(words)) - 1
    v = full
    for x in heard:
        if m := masks.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(words) - v.bit_count()


def best_window(words: Sequence[str], heard: Sequence[str], gap: float) -> int:
    """The most of the words that any stretch of ``heard`` of their number and ``gap`` of it more has in order."""
    wide = math.ceil(len(words) * (1 + gap))
    most = 0
    for at in range(max(1, len(heard) - wide + 1)):
        most = max(most, in_order(words, heard[at : at + wide]))
        if most == len(words):
            break
    return most


def _in_order(gap: float):
    @F.pandas_udf(IntegerType())
    def matched(words: pd.Series, heard: pd.Series) -> pd.Series:
        return pd.Series([best_window(list(a), list(b), gap) for a, b in zip(words, heard)], dtype="int32")

    return matched


def license_spans(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = GRAM, band: int = BAND, share: float = SHARE, strong: float = STRONG, gap: float = GAP) -> DataFrame:
    """(doc_id, license, start_word, end_word, votes, matched_words, similarity): spans of documents that repeat a template.

    All rolling word ``gram``-gram hashes are joined to the templates' positions; hits vote for (document, template, diagonal),
    the diagonal being the document's position less the template's. Diagonals at most ``band`` apart, whose hits follow one another
    within twice the template's length, are merged into islands; islands with votes for at least ``strong`` of the template's words that
    are at most ``gap`` of its length apart (a phrase inserted or left out) are joined into one span. A span is verified on the words
    themselves: those of the template that a stretch of the span, at most ``gap`` longer than the template, has in the template's order are
    matched; spans with at least ``share`` of the words matched are returned.

    Words are runs of letters, digits and characters beyond ASCII, in lower case. Templates of fewer than ``gram`` words are never found.
    Nulls: documents with null text have no row; a null doc_id is returned as null. Empty texts and texts under ``gram`` words have no row.
    Documents with the same doc_id and different texts are scanned apart; exactly repeated rows give their spans once. Texts of any length
    are scanned whole. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").filter("text IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    listed = [(i, name, template_words(text)) for i, (name, text) in enumerate(templates)]
    listed = [x for x in listed if len(x[2]) >= gram]
    positions = []
    for i, _, words in listed:
        for _, _, _, _, _, _, hashes, before in scan(*text_bytes(pa.array([" ".join(words)]))):
            positions += [(i, p, int(h)) for p, h in enumerate(grams(hashes, before, gram)[0].view(np.int64))]
    at = spark.createDataFrame(positions or [(-1, 0, 0)], "template int, tpos int, gram long")
    hint = F.broadcast if len(positions) <= BROADCAST_ROWS else (lambda x: x)
    hits = _gram_rows(docs, gram).join(hint(at), "gram").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    # Repeated rows vote twice at the same place: distinct positions are counted.
    key = ["doc_id", "text_key", "template"]
    votes = hits.groupBy(*key, "diagonal", "pos").agg(F.lit(1).alias("one")).groupBy(*key, "diagonal").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"), (F.max("pos") + gram).alias("last"))
    w = Window.partitionBy(*key).orderBy("diagonal")
    t = spark.createDataFrame([(i, name, words, len(words)) for i, name, words in listed] or [(-1, "", [""], 1)], "template int, license string, words array<string>, n int")
    near = (F.col("diagonal") - F.lag("diagonal").over(w) <= band) & (F.abs(F.col("first") - F.lag("first").over(w)) <= 2 * F.col("n"))
    merged = (
        votes.join(hint(t.select("template", "n")), "template")
        .withColumn("new", F.when(near, 0).otherwise(1))
        .withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "island").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.min("first").alias("start_word"), F.max("last").alias("end_word"))
    )
    along = Window.partitionBy(*key).orderBy("low", "start_word")
    joined = (F.col("low") - F.lag("high").over(along) <= gap * F.col("n")) & (F.abs(F.col("start_word") - F.lag("start_word").over(along)) <= 2 * F.col("n"))
    merged = cut(
        merged.join(hint(t.select("template", "n")), "template").filter(F.col("votes") >= strong * F.col("n"))
        .withColumn("new", F.when(joined, 0).otherwise(1))
        .withColumn("chain", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "chain").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    )
    ids = checked_broadcast(cut(merged.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()))
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi").dropDuplicates(["doc_id", "text_key"])
    spoken = texts.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.regexp_extract_all(F.lower("text"), F.lit(f"({_WORD})"), F.lit(1)).alias("spoken"))
    # The slice of words that the span's diagonals reach; the whole list isn't carried along.
    reach = F.greatest(F.col("low"), F.lit(0))
    cand = (
        merged.join(hint(t), "template")
        .join(spoken, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
        .withColumn("heard", F.slice("spoken", reach + 1, F.col("high") - reach + F.col("n")))
        .drop("spoken")
    )
    return (
        cand.withColumn("matched_words", _in_order(gap)("words", "heard")).withColumn("similarity", F.col("matched_words") / F.col("n")).filter(F.col("similarity") >= share)
        .select("doc_id", "license", "start_word", "end_word", "votes", "matched_words", "similarity")
    )


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, gram: int = GRAM, band: int = BAND, share: float = SHARE, strong: float = STRONG, gap: float = GAP) -> str:
    rows = ", ".join(f"('{name}', {template_words(text)!r})" for name, text in templates)
    g = lambda words, p: f"array_to_string(list_slice({words}, {p} + 1, {p} + {gram}), ' ')"
    return f"""
WITH RECURSIVE t AS (SELECT *, len(words) AS n FROM (VALUES {rows}) AS v(license, words)),
tp AS (SELECT license, n, p AS tpos, {g('words', 'p')} AS gram FROM (SELECT license, n, words, unnest(range(0, n - {gram} + 1)) AS p FROM t)),
d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS spoken FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, text, p AS pos, {g('spoken', 'p')} AS gram FROM (SELECT doc_id, text, spoken, unnest(range(0, len(spoken) - {gram} + 1)) AS p FROM d)),
votes AS (SELECT doc_id, text, license, n, pos - tpos AS diagonal, count(DISTINCT pos) AS votes, min(pos) AS first, max(pos) + {gram} AS last
  FROM dp JOIN tp USING (gram) GROUP BY ALL),
flagged AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= {band} AND abs(first - lag(first) OVER w) <= 2 * n THEN 0 ELSE 1 END AS new
  FROM votes WINDOW w AS (PARTITION BY doc_id, text, license ORDER BY diagonal)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, license ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
bands AS (SELECT doc_id, text, license, any_value(n) AS n, sum(votes) AS votes, min(diagonal) AS low, max(diagonal) AS high, min(first) AS start_word, max(last) AS end_word
  FROM islands GROUP BY doc_id, text, license, island HAVING sum(votes) >= {strong} * any_value(n)),
linked AS (SELECT *, CASE WHEN low - lag(high) OVER w <= {gap} * n AND abs(start_word - lag(start_word) OVER w) <= 2 * n THEN 0 ELSE 1 END AS new
  FROM bands WINDOW w AS (PARTITION BY doc_id, text, license ORDER BY low, start_word)),
chains AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, license ORDER BY low, start_word ROWS UNBOUNDED PRECEDING) AS chain FROM linked),
merged AS (SELECT doc_id, text, license, any_value(n) AS n, sum(votes) AS votes, min(low) AS low, max(high) AS high, min(start_word) AS start_word, max(end_word) AS end_word
  FROM chains GROUP BY doc_id, text, license, chain),
cand AS (SELECT row_number() OVER () AS c, m.*, t.words, list_slice(d.spoken, greatest(m.low, 0) + 1, m.high + m.n) AS heard
  FROM merged m JOIN t USING (license) JOIN d ON m.doc_id IS NOT DISTINCT FROM d.doc_id AND m.text = d.text),
windows AS (SELECT c, n, words, heard, unnest(range(0, greatest(1, len(heard) - CAST(ceil(n * {1 + gap}) AS INTEGER) + 1))) AS s FROM cand),
seen AS (SELECT c, s, n, words, list_filter(list_slice(heard, s + 1, s + CAST(ceil(n * {1 + gap}) AS INTEGER)), lambda h: list_contains(words, h)) AS heard FROM windows),
-- the longest common subsequence, a word of the document at a time; lcs[j] is that of the template's first j words
step AS (SELECT c, s, 0 AS i, list_transform(range(0, n), lambda j: 0) AS lcs FROM seen
  UNION ALL SELECT x.c, x.s, i + 1, list_transform(range(1, n + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN words[k] = heard[i + 1] THEN CASE WHEN k = 1 THEN 1 ELSE lcs[k - 1] + 1 END ELSE lcs[k] END)))
  FROM step x JOIN seen y ON x.c = y.c AND x.s = y.s WHERE i < len(heard)),
ordered AS (SELECT x.c, max(lcs[n]) AS matched_words FROM step x JOIN seen y ON x.c = y.c AND x.s = y.s WHERE i = len(heard) GROUP BY x.c)
SELECT doc_id, license, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, CAST(votes AS BIGINT) AS votes, CAST(matched_words AS INTEGER) AS matched_words, matched_words / n AS similarity
FROM cand JOIN ordered USING (c) WHERE matched_words / n >= {share}"""


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE = {"op1_license_scan": oracle()}
