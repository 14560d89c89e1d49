"""Embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import cut, only
from wirelake.llm.grouping import bucket_groups
from wirelake.llm.wordscan import mix

#: RECALL is what the tables find of the pairs right at the threshold; SAMPLE the vectors that the plan looks at, with their bytes bounded too;
#: PAIR_COST what the verification of a candidate costs against one key of a vector.
THRESHOLD, PROBES, CELL, RECALL = 0.95, 4, 1.0, 0.99
SAMPLE, SAMPLE_BYTES, PAIR_COST, MOST_BLOCKS = 2048, 32 << 20, 12.0, 32
_U64 = np.uint64


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8: whole coordinates of even sum."""
    near = np.rint(x)
    odd = (near.sum(-1) % 2) != 0
    off = x - near
    worst = np.abs(off).argmax(-1)
    rows = np.flatnonzero(odd)
    cols = worst[rows]
    near[rows, cols] += np.where(off[rows, cols] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 = D8 and D8 + 1/2 to the rows of ``x`` (n, 8)."""
    a = _d8(x)
    b = _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(-1) <= ((x - b) ** 2).sum(-1))[:, None], a, b)


def _roots() -> np.ndarray:
    """The 240 least vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for s in (1, -1):
                for t in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = s, t
                    out.append(v)
    for m in range(256):
        v = np.array([0.5 if m >> i & 1 else -0.5 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()
#: One of each root and its negative: the first element that isn't 0 is positive.
_HALF = ROOTS[ROOTS[np.arange(len(ROOTS)), (ROOTS != 0).argmax(1)] > 0]


def cells(vectors: np.ndarray, tables: int, blocks: int, probes: int, cell: float) -> np.ndarray:
    """(n, tables, 1 + probes) keys of the cells that each unit vector enters: its own and the ``probes`` next nearest.

    A table projects onto ``blocks`` times eight orthonormal directions, scaled so that ``cell`` of distance is one lattice unit, and
    decodes each eight to an E8 point. A neighbouring cell has one block's point moved by the least vector nearest to the residual
    (``probes`` is at most 120, the number of those on one side).
    """
    n, d = vectors.shape
    r = np.random.default_rng(808)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    salt = (np.arange(1, blocks * 8 + 1, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15)).reshape(blocks, 8)

    def key(points: np.ndarray, t: int) -> np.ndarray:
        h = np.full(len(points), t + 1, np.uint64)
        twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
        for b in range(blocks):
            h = mix(h ^ (twice[:, b] * salt[b]).sum(1, dtype=np.uint64))
        return h

    for t in range(tables):
        wide = max(d, blocks * 8)
        basis = np.linalg.qr(r.normal(size=(wide, blocks * 8)))[0][:d] * np.sqrt(wide / 8) / cell
        shift = r.uniform(0, 1, blocks * 8)
        for lo in range(0, n, 4096):
            x = (vectors[lo : lo + 4096] @ basis + shift).reshape(-1, blocks, 8)
            m = len(x)
            own = np.stack([decode(x[:, b]) for b in range(blocks)], 1)
            out[lo : lo + m, t, 0] = key(own, t)
            if not probes:
                continue
            rows = np.arange(m)
            gains, moves = [], []
            for b in range(blocks):
                g = (x[:, b] - own[:, b]) @ _HALF.T
                size = np.abs(g)
                for _ in range(probes):
                    top = size.argmax(1)
                    gains.append(size[rows, top])
                    moves.append(np.where((g[rows, top] < 0)[:, None], -_HALF[top], _HALF[top]))
                    size[rows, top] = -1
            gain, move = np.stack(gains, 1), np.stack(moves, 1)
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            for q in range(probes):
                c = best[:, q]
                point = own.copy()
                point[rows, c // probes] += move[rows, c]
                out[lo : lo + m, t, 1 + q] = key(point, t)
    return out


class Plan(NamedTuple):
    blocks: int
    tables: int


def _at_cosine(n: int, d: int, cosine: float, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    x = r.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(n, d))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y


def plan(sample: np.ndarray, n: int, threshold: float = THRESHOLD, probes: int = PROBES, cell: float = CELL, recall: float = RECALL) -> Plan:
    """How many E8 blocks make a cell and how many tables there are, for ``n`` vectors of which ``sample`` has some.

    More blocks make cells smaller, so that fewer unrelated vectors meet (their number in a cell grows with n), but need more tables for
    the same recall. The rate at which pairs that are no duplicates meet is taken from the sample's own pairs: a block's rate at their
    cosines to the power of the blocks. Recall is simulated at the threshold. The cheapest plan is returned: keys plus candidates of a
    vector; so the work for a vector grows slowly (a small power of n), not in proportion to n.
    """
    r = np.random.default_rng(909)
    d = sample.shape[1]
    grid = np.array([-1.0, -0.5, -0.25, 0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.85, 0.9, 0.95, 1.0])
    basis = np.linalg.qr(r.normal(size=(max(d, 8), 8)))[0][:d] * np.sqrt(max(d, 8) / 8) / cell
    shift = r.uniform(0, 1, 8)
    rate = np.maximum.accumulate([(decode(x @ basis + shift) == decode(y @ basis + shift)).all(1).mean() for x, y in (_at_cosine(4000, d, c, r) for c in grid)])
    cosine = (sample @ sample.T)[np.triu_indices(len(sample), 1)]
    meet = np.interp(cosine[cosine < threshold], grid, np.maximum(rate, 1e-4))
    near = _at_cosine(1500, d, threshold, r)
    best: tuple[float, Plan] | None = None
    for blocks in range(1, MOST_BLOCKS + 1):
        a, b = (cells(v, 1, blocks, probes, cell)[:, 0] for v in near)
        q = float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())
        if q <= 0:
            break
        tables = 1 if q >= recall else math.ceil(math.log(1 - recall) / math.log(1 - q))
        candidates = n * (1 + probes) ** 2 * (float((meet**blocks).mean()) if len(meet) else 0.0)
        cost = tables * (1 + probes + PAIR_COST * candidates)
        if best is not None and cost > 1.5 * best[0]:
            break
        if best is None or cost < best[0]:
            best = cost, Plan(blocks, tables)
    return best[1]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)


def unit_bytes(column: pa.Array) -> pa.Array:
    """The rows' unit vectors as 32-bit floats; null for those without direction. All rows are worked on at once."""
    v = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    norm = np.zeros(len(n))
    if len(v):
        norm[n > 0] = np.sqrt(np.add.reduceat(v * v, off[:-1][n > 0]))
    good = np.isfinite(norm) & (norm > 0)
    with np.errstate(invalid="ignore"):
        unit = (v / np.repeat(np.where(good, norm, 1.0), n)).astype(np.float32)
    bits = np.packbits(good, bitorder="little")
    return pa.Array.from_buffers(pa.large_binary(), len(n), [pa.py_buffer(bits), pa.py_buffer(off * 4), pa.py_buffer(unit)]).cast(pa.binary())


def _units(rows: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, dim, unit): unit vectors in 32-bit floats, null without direction; k1 and k2 are 128 bits that name the exact vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "k1", "k2", "dim")), unit_bytes(batch.column("embedding"))], ["vec_id", "k1", "k2", "dim", "unit"])

    key = lambda seed: F.xxhash64(F.lit(seed), F.size("embedding"), F.col("embedding"))
    rows = rows.filter("embedding IS NOT NULL").select("vec_id", key(1).alias("k1"), key(2).alias("k2"), F.size("embedding").alias("dim"), "embedding")
    return rows.mapInArrow(run, "vec_id long, k1 long, k2 long, dim int, unit binary")


def _members(nodes: DataFrame, p: Plan, probes: int, cell: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                c = cells(_matrix(batch.column("unit").take(at)), p.tables, p.blocks, probes, cell)
                keys = mix(c ^ np.uint64(int(dim))).reshape(len(c), -1).view(np.int64)
                node = batch.column("node").take(at).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(node, keys.shape[1]))], ["bucket", "node"])

    return nodes.mapInArrow(run, "bucket long, node long")


def _planned(nodes: DataFrame, threshold: float, probes: int, cell: float, recall: float) -> Plan | None:
    """The plan for ``nodes``, by a bounded sample of their most usual dimension: those whose node numbers have the least hashes."""
    n, widest = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return None
    most = max(64, min(SAMPLE, SAMPLE_BYTES // (4 * widest)))
    rows = nodes.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(most).select("dim", "unit").collect()
    dims = [r["dim"] for r in rows]
    usual = max(set(dims), key=lambda x: (dims.count(x), x))
    return plan(np.stack([np.frombuffer(bytes(r["unit"]), np.float32).astype(float) for r in rows if r["dim"] == usual]), n, threshold, probes, cell, recall)


def _close(threshold: float):
    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        same = a.str.len() == b.str.len()
        out = pd.Series(False, index=a.index)
        for n in a[same].str.len().unique():
            at = same & (a.str.len() == n)
            x, y = (np.frombuffer(b"".join(s[at]), np.float32).reshape(-1, n // 4).astype(np.float64) for s in (a, b))
            out[at] = (x * y).sum(1) >= threshold
        return out

    return close


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, cell: float = CELL, recall: float = RECALL) -> DataFrame:
    """(vec_id, duplicate_of, group_size): every vector of a group but the one of least vec_id, which is duplicate_of.

    Vectors of cosine at least ``threshold`` are near duplicates; groups are the connected components. Candidates are in one cell of one of
    several lattices, of which each vector enters its own and ``probes`` neighbouring ones; all candidates' cosines are verified. A bounded
    sample (SAMPLE vectors) decides how many E8 points make a cell and how many lattices there are, see ``plan``; all vectors are hashed.

    Every vector is a query. Nulls: rows with null embedding have no group; a null vec_id takes part and comes last in the choice. Vectors with
    a null, NaN or infinite element, empty vectors and zero vectors have no direction: they group only with exact copies. Vectors of different
    length aren't compared. Repeated rows are copies (a repeated vec_id that stays isn't listed). An empty table gives an empty result. Other
    columns are ignored.
    """
    units = cut(_units(only(vectors, "vec_id", "embedding")))
    nodes = cut(units.groupBy("k1", "k2").agg(F.first("dim").alias("dim"), F.first("unit").alias("unit")).withColumn("node", F.monotonically_increasing_id()))
    pointed = nodes.filter("unit IS NOT NULL")
    if (p := _planned(pointed, threshold, probes, cell, recall)) is None:
        root = nodes.select("node", F.col("node").alias("root")).limit(0)
    else:

        def verify(edges: DataFrame) -> DataFrame:
            x = pointed.select(F.col("node").alias("b"), F.col("unit").alias("unit_b"))
            y = pointed.select(F.col("node").alias("a"), F.col("unit").alias("unit_a"))
            return edges.join(x, "b").join(y, "a").filter(_close(threshold)("unit_a", "unit_b")).select("a", "b")

        root = bucket_groups(_members(pointed, p, probes, cell), verify)
    # Exact copies meet in their node; the pairs of nodes that match are few, so what is joined here is short.
    at = nodes.select("k1", "k2", "node").join(root, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    of = cut(units.select("vec_id", "k1", "k2").join(at, ["k1", "k2"]).select("vec_id", "root"))
    sizes = of.groupBy("root").agg(F.min("vec_id").alias("duplicate_of"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return of.join(sizes, "root").filter("NOT vec_id <=> duplicate_of").select("vec_id", "duplicate_of", "group_size")


def _pairs_sql(table: str) -> str:
    return f"""
WITH RECURSIVE v AS ({table}),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT x, x AS y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
g AS (SELECT x AS vec_id, min(y) AS duplicate_of, count(*) AS group_size FROM reach GROUP BY x)
SELECT * FROM g WHERE vec_id <> duplicate_of"""


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: How far the two planted copies of each vector are turned: the first is near the vector and the second near the first only.
_TURNS = (0.22, 0.4)
_PLANTED = 1_000_000_000


def embedding_near_dedup_planted(spark, sf_dir: str) -> DataFrame:
    """``duplicates`` over all vectors and two turned copies of each (element i plus a multiple of element i + 1), as the given tables have hardly any near copies."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = v
    for k, turn in enumerate(_TURNS, 1):
        turned = F.expr(f"transform(embedding, (x, i) -> x + CAST({turn} AS DOUBLE) * embedding[pmod(i + 1, size(embedding))])")
        out = out.unionByName(v.select((F.col("vec_id") + k * _PLANTED).alias("vec_id"), turned.alias("embedding")))
    return duplicates(out)


_PLANTED_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings" + "".join(
    f" UNION ALL SELECT vec_id + {k * _PLANTED}, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CAST({turn} AS DOUBLE) * CAST(embedding[i % len(embedding) + 1] AS DOUBLE)) FROM embeddings"
    for k, turn in enumerate(_TURNS, 1)
)
QUERIES = {"op3_embedding_near_dedup": op3_embedding_near_dedup, "embedding_near_dedup_planted": embedding_near_dedup_planted}
ORACLE = {"op3_embedding_near_dedup": _pairs_sql("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"), "embedding_near_dedup_planted": _pairs_sql(_PLANTED_SQL)}
