"""Token counts through a cache of digests."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import checked_broadcast, cut, delete_at_exit, give_back, only, scratch_path, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's text is cut into pieces: contractions, words, numbers, signs, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SCHEMA = "digest binary, version string, tokens long"


def normalised(text: Column) -> Column:
    """Line ends become \\n; a trailing run of white space goes. What is counted is this text."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\s+\z", "")


def vocabulary_version(path: str, pattern: str = PATTERN) -> str:
    """The tokenizer's version: a digest of its vocabulary file and of its pattern."""
    import hashlib

    return hashlib.sha256(Path(path).read_bytes() + b"\0" + pattern.encode()).hexdigest()[:16]


def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).open("rb"))}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t.as_py())) for t in batch.column("normal")]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "tokens"])
            give_back()

    return run


def counted(docs: DataFrame, cache: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens) of every document row; the cache at ``cache`` (a folder of Parquet, made if missing) is extended by what it lacked.

    Documents' normalised texts and the tokenizer's version are joined by digest to the stored counts; only distinct misses are encoded, once
    each, and appended. A concurrent or repeated append may store a count twice; reading takes one of each. ``vocabulary`` must be readable
    under that path on all executors.

    Nulls: a null text has null tokens; a null doc_id is kept. Empty texts have 0 tokens. Repeated rows and equal texts are encoded once.
    An empty table gives an empty result. Texts are encoded whole, of any length. Other columns are ignored.
    """
    spark = docs.sparkSession
    version = vocabulary_version(vocabulary, pattern)
    keyed = only(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("normal")).withColumn("digest", F.unhex(F.md5("normal")))
    ids = cut(keyed.select("doc_id", "digest"))
    known = _cache(spark, cache, version)
    misses = ids.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"))
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    # One document row of each missing text encodes it. While the misses' short keys can be broadcast, texts aren't shuffled.
    short = cut(misses.select(_short().alias("__key"), F.col("id").alias("__id")))
    chosen = keyed.filter("digest IS NOT NULL").join(checked_broadcast(short), (_short() == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    new = chosen.select("digest", "normal").mapInArrow(_count(vocabulary, pattern), "digest binary, tokens long")
    with small_batches(spark):
        new.dropDuplicates(["digest"]).select("digest", F.lit(version).alias("version"), "tokens").write.mode("append").parquet(cache)
    return ids.join(_cache(spark, cache, version), "digest", "left").select("doc_id", "tokens")


def token_count(text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """The tokens of the normalised text, encoded in the pass that reads it, without a cache; a null text has 0."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary, pattern)
        for s in texts:
            yield s.map(lambda t: 0 if t is None else len(enc.encode_ordinary(t))).astype("int64")
            give_back()

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(normalised(F.col(text)))


def _short() -> Column:
    return F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")


def _cache(spark, cache: str, version: str) -> DataFrame | None:
    """(digest, tokens) of the tokenizer's version; None if there is no cache yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(_SCHEMA).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.first("tokens").alias("tokens"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts with a cache of its own that is empty at first, so all distinct texts are encoded."""
    return counted(spark.read.parquet(f"{sf_dir}/documents.parquet"), delete_at_exit(spark, scratch_path(spark, "token-cache")))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
