"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import checked_broadcast, cut, extra_aside, only

SEED, TEMPERATURE, BUCKETS = 17, 0.5, 64
_WIDE = 16**12


def _unit(seed: int) -> Column:
    """A number in (0, 1) from the seed, doc_id and n_chars: exact in 49 bits, so it is the same everywhere."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("n_chars").cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(_WIDE)


def sampled(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with the columns ``__certain`` (copies for certain) and ``__drawn`` (1 if drawn for one more); rows with neither stay in.

    Each source gets a fixed number of copies: ``total`` (the number of documents unless given) times its target weight, rounded. Target
    weights are ``weights`` by source (others get 0; nothing is sampled if no weight is left), or the source's number of documents to the power ``temperature``. A document's
    expected copies are its source's number times its size over the source's size, where a document's size is 1 + floor(sqrt(n_chars)).
    Its whole expected copies are allocated for certain; the fractions p are sampled by Pareto order sampling: documents are ranked by
    U / (1 - U) / (p / (1 - p)) with uniform U, and the source's first ones are drawn, as many as the fractions come to.

    Nulls: documents with null source are a source of their own; null or negative n_chars counts as 0. Empty texts have size 1. Ties
    (repeated rows) rank by doc_id, and among exact repeats any does. An empty table gives an empty result. Extra columns stay.
    """
    size = (F.lit(1) + F.floor(F.sqrt(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0)).cast("double")))).cast("long")
    rows = docs.withColumn("__s", F.coalesce("source", F.lit("\0"))).withColumn("__x", size)
    per = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("n"), F.sum("__x").alias("x_sum"))
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)) if temperature != 0.5 else F.sqrt(F.col("n").cast("double")))
    else:
        per = per.withColumn("w", F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k in weights.items() for v in (k[0], float(k[1]))]), F.col("__s")), F.lit(0.0)))
    sums = per.agg(F.sum("w").alias("w_sum"), F.sum("n").alias("n_sum"))
    goal = F.lit(total) if total is not None else F.col("n_sum")
    per = cut(per.crossJoin(F.broadcast(sums)).select("__s", "x_sum", F.floor(F.coalesce(F.try_divide(goal * F.col("w"), F.col("w_sum")), F.lit(0.0)) + 0.5).cast("long").alias("goal")))
    expected = F.col("goal").cast("double") * F.col("__x").cast("double") / F.col("x_sum").cast("double")
    u = _unit(seed)
    rows = (
        rows.join(checked_broadcast(per), "__s")
        .withColumn("__certain", F.floor(expected).cast("long"))
        .withColumn("__p", F.col("goal").cast("double") * F.col("__x").cast("double") / F.col("x_sum").cast("double") - F.col("__certain"))
        .withColumn("__u", u)
        .withColumn("__q", F.when(F.col("__p") > 0, (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))))
    )
    # The source's number of draws is found exactly without sorting the source: counts by bucket of the rank key, then the one bucket at the edge is ranked.
    bucket = F.when(F.col("__q").isNull(), F.lit(2**30)).otherwise(F.floor(F.log2("__q") * BUCKETS).cast("int"))
    rows = rows.withColumn("__b", bucket)
    certain = rows.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("n"), F.sum("__certain").alias("c"), F.first("goal").alias("goal"))
    w = Window.partitionBy("__s")
    edge = cut(
        certain.withColumn("need", F.col("goal") - F.sum("c").over(w))
        .withColumn("upto", F.sum("n").over(w.orderBy("__b")))
        .filter("upto >= need AND upto - n < need")
        .select("__s", F.col("__b").alias("__edge"), (F.col("need") - F.col("upto") + F.col("n")).alias("__take"))
    )
    rows = rows.join(checked_broadcast(edge), "__s", "left")
    names = docs.columns
    return rows, names


def _draws(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with __copies, of which documents without copies are dropped."""
    below = rows.filter(F.col("__edge").isNull() | (F.col("__b") != F.col("__edge")))
    below = below.withColumn("__copies", F.col("__certain") + F.when(F.col("__b") < F.col("__edge"), 1).otherwise(0))
    order = Window.partitionBy("__s", "__b").orderBy("__q", "doc_id", "n_chars")
    at = rows.filter(F.col("__b") == F.col("__edge")).withColumn("__r", F.row_number().over(order))
    at = at.withColumn("__copies", F.col("__certain") + F.when(F.col("__r") <= F.col("__take"), 1).otherwise(0))
    kept = [*[F.col(f"`{c}`") for c in names], "__copies"]
    return below.select(*kept).unionByName(at.select(*kept)).filter("__copies > 0")


@extra_aside("doc_id", "source", "n_chars")
def mix(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with each document as often as it is sampled; see ``sampled`` for the method, its parameters and its edge cases."""
    rows, names = sampled(docs, **params)
    out = _draws(rows, names)
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return out.select(*[F.col(f"`{c}`") for c in names], copies.alias("__copy")).drop("__copy")


def copies(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, source, copies) of the sampled documents."""
    rows, names = sampled(only(docs, "doc_id", "source", "n_chars"), **params)
    return _draws(rows, names).select("doc_id", "source", F.col("__copies").alias("copies"))


ORACLE_COPIES = f"""
WITH d AS (SELECT doc_id, source, 1 + CAST(floor(sqrt(CAST(greatest(coalesce(n_chars, 0), 0) AS DOUBLE))) AS BIGINT) AS x,
    (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(CAST(n_chars AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / {float(_WIDE)!r} AS u FROM documents),
s AS (SELECT source, count(*) AS n, sum(x) AS x_sum, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM d GROUP BY source),
g AS (SELECT source, x_sum, floor((SELECT sum(n) FROM s) * w / (SELECT sum(w) FROM s) + 0.5) AS goal FROM s),
e AS (SELECT d.*, goal, floor(CAST(goal AS DOUBLE) * CAST(x AS DOUBLE) / CAST(x_sum AS DOUBLE)) AS certain, CAST(goal AS DOUBLE) * CAST(x AS DOUBLE) / CAST(x_sum AS DOUBLE) - floor(CAST(goal AS DOUBLE) * CAST(x AS DOUBLE) / CAST(x_sum AS DOUBLE)) AS p FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, goal - sum(certain) OVER (PARTITION BY source) AS need, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id) AS k FROM e),
c AS (SELECT doc_id, source, CAST(certain + CASE WHEN k <= need THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r)
SELECT * FROM c WHERE copies > 0"""


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLE = {"op10_mix_sources": ORACLE_COPIES}
