"""Best-fit packing of documents into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import checked_broadcast, cut, only
from wirelake.llm.op08_tokens import token_count

#: CAPACITY is in what ``length`` of ``pack`` counts; ROWS_A_TASK the documents and gaps that one task of a sweep sorts.
CAPACITY, ROWS_A_TASK = 2048, 200_000


def token_length(text: str = "text") -> Column:
    """Words, and signs that are neither word nor space, counted in the JVM: not a tokenizer's tokens, of which texts have about twice as many, and scripts without spaces far more."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")), F.lit(0)).cast("long")


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of sizes, from large to small: each document takes the least gap before it that is still free.

    Returns every row with the other's id, or with its rank among the range's documents or gaps that are left.
    """
    part = [f for f in frames if len(f)]
    if not part:
        return
    f = pd.concat(part, ignore_index=True)
    size, kind, uid = f["size"].to_numpy(), f["kind"].to_numpy(), f["uid"].to_numpy()
    to = np.full(len(f), -1, np.int64)
    rank = np.full(len(f), -1, np.int64)
    stack: list[int] = []
    lost = 0
    for i, k in enumerate(kind.tolist()):
        if k == 0:
            stack.append(i)
        elif stack:
            to[i] = stack.pop()
        else:
            rank[i] = lost
            lost += 1
    rank[stack] = np.arange(len(stack))
    matched = to >= 0
    got = np.where(matched, uid[to], -1)
    keep = (kind == 1) | (rank >= 0)
    yield pd.DataFrame({"part": f["part"], "kind": kind, "uid": uid, "size": size, "got": got, "gap": np.where(matched, size[to], 0), "rank": rank})[keep]


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Matches what the ranges have left: (range, documents, gaps) from large to small sizes gives rows (piece, kind, range, first rank, number).

    In each range the documents left come before the gaps left; a document takes the last gap that is free, so the successor of its size.
    Piece by piece, the documents from the first rank upwards match the gaps from the first rank downwards.
    """
    stack: list[list[int]] = []
    out, piece = [], 0
    for part, docs, gaps in left:
        done = 0
        while done < docs and stack:
            at, free = stack[-1]
            n = min(docs - done, free)
            out += [(piece, 1, part, done, n), (piece, 0, at, free - 1, n)]
            piece += 1
            done += n
            stack[-1][1] -= n
            if stack[-1][1] == 0:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return out


def _round(docs: DataFrame, gaps: DataFrame, n_rows: int) -> DataFrame:
    """(uid, size, bin): the documents of ``docs`` (uid, size) that get a gap of ``gaps`` (bin, gap), each gap at most once."""
    spark = docs.sparkSession
    both = gaps.select(F.col("gap").alias("size"), F.lit(0).alias("kind"), F.col("bin").alias("uid")).unionByName(docs.select("size", F.lit(1).alias("kind"), "uid"))
    parts = max(1, -(-n_rows // ROWS_A_TASK))
    order = [F.desc("size"), F.asc("kind"), F.asc("uid")]
    swept = both.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    swept = cut(swept.mapInPandas(_sweep, "part int, kind int, uid long, size long, got long, gap long, rank long"))
    here = swept.filter("kind = 1 AND got >= 0").select("uid", "size", F.col("got").alias("bin"))
    if parts == 1:
        return here
    left = swept.filter("rank >= 0").groupBy("part").agg(F.count_if(F.col("kind") == 1).alias("d"), F.count_if(F.col("kind") == 0).alias("g")).collect()
    pieces = across(sorted((r["part"], r["d"], r["g"]) for r in left))
    if not pieces:
        return here
    # At most twice as many pieces as ranges.
    p = F.broadcast(spark.createDataFrame(pieces, "piece int, kind int, part int, first long, n long"))
    docs_left = swept.filter("rank >= 0 AND kind = 1").join(p, ["part", "kind"]).filter("rank >= first AND rank < first + n").select("piece", (F.col("rank") - F.col("first")).alias("k"), "uid", "size")
    gaps_left = swept.filter("rank >= 0 AND kind = 0").join(p, ["part", "kind"]).filter("rank <= first AND rank > first - n").select("piece", (F.col("first") - F.col("rank")).alias("k"), F.col("uid").alias("bin"))
    return here.unionByName(docs_left.join(gaps_left, ["piece", "k"]).select("uid", "size", "bin"))


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None) -> DataFrame:
    """(bin, doc_id, part, start, length, position): every document's tokens in sequences of at most ``capacity``.

    ``length`` is a column of ``docs`` that counts a document's tokens, as ``op08_tokens.token_count`` does; without it words and signs are
    counted (``token_length``) in place of tokens.

    Documents longer than ``capacity`` are cut: full parts fill a bin each, what is left over is packed as a document. The others are packed
    by rounds. In a round, documents and the open bins' gaps are sorted by size into ranges; a sweep from large to small gives each document
    the least free gap that holds it (its successor), so of documents that want the same gap the first by rank, the largest, gets it and the
    others the next gaps; what ranges have left over is matched across ranges from their counts. Then gaps are updated. A gap that holds the
    largest document left several times takes part as so many gaps, so small documents don't take a round each. When no document finds a
    gap, as many bins are opened as the rest needs at least, until all are placed.

    Nulls: a null text has length 0, as have empty texts and those of white space, and a null or negative ``length`` counts as 0; such documents are in no bin: bin and position are null. A null doc_id is packed as any other.
    Repeated rows are packed each on its own. Ties of size are ranked by row. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = (only(docs, "doc_id", "text") if length is None else docs).select("doc_id", F.greatest(F.coalesce(token_length() if length is None else length, F.lit(0)).cast("long"), F.lit(0)).alias("n"))
    parts = F.when(F.col("n") > capacity, F.transform(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1), lambda i: i)).otherwise(F.array(F.lit(0)))
    items = cut(
        sized.select("doc_id", "n", F.explode(parts).alias("part"))
        .select("doc_id", "part", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.col("n") - F.col("part").cast("long") * capacity, F.lit(capacity)).alias("size"))
        .withColumn("uid", F.monotonically_increasing_id())
    )
    left = cut(items.filter(f"size > 0 AND size < {capacity}").select("uid", "size"))
    gaps = None
    bins = 0
    placed: list[DataFrame] = []
    n, total, most = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.max("size")).first()
    n_gaps, largest_gap = 0, 0
    while n:
        if not n_gaps or largest_gap < 1:
            new = -(-total // capacity)
            fresh = spark.range(bins, bins + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap"))
            gaps = fresh if gaps is None else gaps.unionByName(fresh)
            bins += new
            n_gaps += new
        # slots: as many as surely hold the largest document left; slots of a bin differ in number
        times = F.greatest(F.floor(F.col("gap") / F.lit(most)), F.lit(1)).cast("int")
        slots = cut(gaps.select("bin", "gap", times.alias("times")).select(F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("slot"), "bin", F.floor(F.col("gap") / F.col("times")).alias("gap")))
        slots = slots.withColumn("key", F.col("bin") * (capacity + 1) + F.col("slot"))
        got = cut(_round(left, slots.select(F.col("key").alias("bin"), "gap"), n + slots.count()).select("uid", "size", F.expr(f"bin DIV {capacity + 1}").alias("bin")))
        used = got.groupBy("bin").agg(F.sum("size").alias("used"))
        placed.append(got)
        left = cut(left.join(got.select("uid"), "uid", "left_anti"))
        n, total, most, least = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.max("size"), F.min("size")).first()
        if not n:
            break
        # gaps under the least document left can't be used any more
        gaps = cut(gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).filter(F.col("gap") >= least))
        n_gaps, largest_gap = gaps.agg(F.count(F.lit(1)), F.coalesce(F.max("gap"), F.lit(0))).first()
    whole = items.filter(f"size = {capacity}").select("uid", "size")
    full = whole.withColumn("bin", F.col("uid") + bins)
    empty = items.filter("size = 0").select("uid", "size", F.lit(None).cast("long").alias("bin"))
    at = full.unionByName(empty)
    for p in placed:
        at = at.unionByName(p)
    # bins are told apart by number only; those of full parts follow the others
    order = Window.partitionBy("bin").orderBy(F.desc("size"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    some = at.filter("bin IS NOT NULL").withColumn("position", F.coalesce(F.sum("size").over(order), F.lit(0)))
    at = some.unionByName(at.filter("bin IS NULL").withColumn("position", F.lit(None).cast("long")))
    return items.drop("size").join(at, "uid").select("bin", "doc_id", "part", "start", F.col("size").alias("length"), "position")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Packed by the tokens of the vocabulary of ``op08_tokens``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=token_count())


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE: dict[str, str] = {}
