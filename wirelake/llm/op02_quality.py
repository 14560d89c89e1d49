"""Quality rules by robust multivariate outlier detection: minimum covariance determinant per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wirelake.llm.common import BROADCAST_ROWS, checked_broadcast, cut, extra_aside, give_back, only
from wirelake.llm.wordscan import IS_WORD, scan, text_bytes

#: ALPHA is the share of clean documents that the cut-off rejects if statistics are normal; SUPPORT the share of documents that the
#: estimate rests on, half for the greatest breakdown point; PRIOR the words of pseudo-evidence that pull short documents to the middle;
#: FLOOR the least standard deviation; WEIGHT the documents of its parent's estimate that each estimate is pooled with.
ALPHA, SUPPORT, PRIOR, FLOOR, WEIGHT = 1e-6, 0.5, 30.0, 0.06, 25.0
#: Concentration goes on until no estimate's log determinant falls by more than TOLERANCE.
TOLERANCE = 1e-3
STATS = ("upper", "symbols", "word_length", "repeats", "stops", "variety")
_P = len(STATS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_RES = 16
#: Estimates that may be broadcast, some 500 bytes each.
_FITS = 100_000
#: What all documents' estimate is pooled with: usual prose, wide.
_USUAL = (math.asin(math.sqrt(0.03)), 0.0, math.log(5.0), math.asin(math.sqrt(0.01)), math.log(0.12) / 2, 0.0)
_USUAL_SD = 0.12


def _upper(x: float, a: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_tail(x: float, p: int) -> float:
    return _upper(x / 2, p / 2)


def chi2_quantile(tail: float, p: int) -> float:
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, p) > tail else (lo, mid)
    return hi


def consistency(share: float, p: int) -> float:
    """What the covariance of the ``share`` innermost normal vectors has to be multiplied by."""
    return share / (1 - chi2_tail(chi2_quantile(1 - share, p), p + 2)) if share < 1 else 1.0


def text_statistics(column: pa.Array, prior: float = PRIOR) -> np.ndarray:
    """Transformed statistics of each text, NaN for texts without words; all of them are close to normal for prose of any length.

    Counts x out of n become arcsin(sqrt((x + prior * p) / (n + prior))) with p a usual share, so short texts come near the middle.
    """
    out = np.full((len(column), _P), np.nan)

    def share(x: np.ndarray, n: np.ndarray, usual: float) -> np.ndarray:
        return np.arcsin(np.sqrt(np.clip((x + prior * usual) / (n + prior), 0, 1)))

    upper_b = np.zeros(256, bool)
    upper_b[65:91] = True
    letter_b = upper_b.copy()
    letter_b[97:123] = True
    symbol_b = np.zeros(256, bool)
    symbol_b[[ord(c) for c in "#$%&*+<=>@[]\\^_`{|}~!/"]] = True
    stop_b = np.zeros(256, bool)
    stop_b[[ord(c) for c in ".,;:?"]] = True
    for i, j, u, rows, word, starts, hashes, before in scan(*text_bytes(column)):
        n = np.diff(before).astype(float)
        full = n > 0
        if not full.any():
            continue

        def per_row(flags: np.ndarray, rows=rows) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return np.diff(sums[rows]).astype(float)

        letters, upper, symbols, stops = per_row(letter_b[u]), per_row(upper_b[u]), per_row(symbol_b[u]), per_row(stop_b[u])
        chars = per_row(word & ((u & 0xC0) != 0x80))
        row = np.repeat(np.arange(j - i), np.diff(before))
        order = np.lexsort((hashes, row))
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][first], minlength=j - i).astype(float)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        repeats = np.bincount(row[same], minlength=j - i).astype(float)
        s = np.stack([
            share(upper, letters, 0.03),
            share(np.minimum(symbols, n), n, 0.0),
            np.log((chars + prior * 5.0) / (n + prior)),
            share(repeats, n, 0.01),
            np.log((np.minimum(stops, n) + prior * 0.12) / (n + prior)) / 2,
            # distinct words against n^0.8, the usual course in prose
            np.log((distinct + prior) / (n**0.8 + prior)) / 2,
        ], axis=1)
        out[i:j][full] = s[full]
    return out


def _signs() -> Column:
    """Whether the text has signs but no word."""
    return F.col("text").rlike(r"\S") & ~F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def statistics(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(doc_id, text_key, lang, source, signs, x0..x5); the statistics of a text without words are null, and signs tells that it isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_statistics(batch.column("text"), prior)
            give_back()
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "text_key", "lang", "source", "signs")] + [pa.array(x[:, k], mask=np.isnan(x[:, k])) for k in range(_P)], ["doc_id", "text_key", "lang", "source", "signs", *[f"x{k}" for k in range(_P)]])

    cols = only(docs, "doc_id", "text", "lang", "source").withColumn("text_key", F.xxhash64("text")).withColumn("signs", _signs())
    return cols.mapInArrow(run, "doc_id long, text_key long, lang string, source string, signs boolean, " + ", ".join(f"x{k} double" for k in range(_P)))


def _d2() -> Column:
    """Squared Mahalanobis distance of x0.. from mean, by the packed inverse in inv."""
    c = [F.col(f"x{k}") - F.col("mean")[k] for k in range(_P)]
    return sum((c[i] * c[j] * F.col("inv")[q] * (1.0 if i == j else 2.0) for q, (i, j) in enumerate(_PAIRS)), F.lit(0.0))


_PARAMS = "fit string, start int, mean array<double>, inv array<double>, logdet double, n long, edge int"


def _solve(factor: float, floor: float):
    """From sums over a subset to mean, inverse covariance and log determinant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{k}"] for k in range(_P)]) / n
                cov = np.zeros((_P, _P))
                for q, (i, j) in enumerate(_PAIRS):
                    cov[i, j] = cov[j, i] = r[f"q{q}"] / n - mean[i] * mean[j]
                cov = cov * factor + np.eye(_P) * floor**2
                inv = np.linalg.inv(cov)
                out.append((r["fit"], int(r["start"]), mean.tolist(), [inv[i, j] for i, j in _PAIRS], float(np.linalg.slogdet(cov)[1]), int(n), int(r.get("edge", 0))))
            yield pd.DataFrame(out, columns=["fit", "start", "mean", "inv", "logdet", "n", "edge"])

    return run


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(f"x{k}").alias(f"s{k}") for k in range(_P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{q}") for q, (i, j) in enumerate(_PAIRS)]]


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start 0: medians and median deviations; start 1: medians and equal scales."""
    for f in frames:
        out = []
        for r in f.to_dict("records"):
            mad = np.maximum(1.4826 * np.array(r["mad"], float), FLOOR)
            for start, sd in enumerate((mad, np.full(_P, FLOOR * 3))):
                out.append((r["fit"], start, list(r["mid"]), [1 / sd[i] ** 2 if i == j else 0.0 for i, j in _PAIRS], float(2 * np.log(sd).sum()), int(r["n"]), 0))
        yield pd.DataFrame(out, columns=["fit", "start", "mean", "inv", "logdet", "n", "edge"])


def mcd(rows: DataFrame, support: float = SUPPORT, floor: float = FLOOR, tolerance: float = TOLERANCE) -> DataFrame:
    """(fit, start, mean, inv, logdet, n): reweighted minimum-covariance-determinant estimate of each ``fit`` over (fit, x0..x5).

    From two deterministic starts, concentration steps each keep the ``support`` share of a fit's vectors that are nearest by
    Mahalanobis distance and estimate mean and covariance anew, until no determinant falls any more; the start of lesser determinant wins
    and is reweighted once. All vectors take part in every step, in one pass: sums by 1/16 octave of the distance, of which the nearest
    octaves are added up, so ties are taken in together.
    """
    q = [F.percentile_approx(f"x{k}", 0.5, 10_000).alias(f"m{k}") for k in range(_P)]
    mids = cut(rows.groupBy("fit").agg(F.count(F.lit(1)).alias("n"), *q).select("fit", "n", F.array(*[f"m{k}" for k in range(_P)]).alias("mid")))
    # The same fits in every step, so they are counted once.
    hint = F.broadcast if mids.count() <= _FITS else (lambda x: x)
    off = rows.join(hint(mids), "fit")
    mads = off.groupBy("fit").agg(F.first("n").alias("n"), F.first("mid").alias("mid"), F.array(*[F.percentile_approx(F.abs(F.col(f"x{k}") - F.col("mid")[k]), 0.5, 10_000) for k in range(_P)]).alias("mad"))
    params = cut(mads.mapInPandas(_starts, _PARAMS))
    nearest = Window.partitionBy("fit", "start").orderBy("b")
    whole = Window.partitionBy("fit", "start")
    first, lump = True, False
    while True:
        b = F.floor(F.log2(1 + _d2()) * _RES).cast("int")
        if lump:
            # Edges hardly move between steps: what is an octave off the last one is summed up in one shell below and one above.
            b = F.greatest(F.least(b, F.col("edge") + _RES), F.col("edge") - _RES)
        at = rows.join(hint(params), "fit").withColumn("b", b)
        shells = at.groupBy("fit", "start", "b").agg(*_sums())
        near = shells.withColumn("upto", F.sum("n").over(nearest)).withColumn("all", F.sum("n").over(whole)).filter(F.col("upto") - F.col("n") < support * F.col("all"))
        names = ["n", *[f"s{k}" for k in range(_P)], *[f"q{i}" for i in range(len(_PAIRS))]]
        new = near.groupBy("fit", "start").agg(*[F.sum(c).alias(c) for c in names], F.max("b").alias("edge")).mapInPandas(_solve(consistency(support, _P), floor), _PARAMS)
        # An estimate whose determinant doesn't fall has converged and stays, so the loop ends. The starts' own determinants are of other scales.
        kept_too = ("mean", "inv", "logdet", "n")
        old = params.select("fit", "start", *[F.col(c).alias(f"old_{c}") for c in (*kept_too, "edge")])
        moved = F.lit(first) | (F.col("logdet") < F.col("old_logdet") - tolerance)
        off = F.lit(lump) & (F.abs(F.col("edge") - F.col("old_edge")) >= _RES)
        stepped = cut(new.join(hint(old), ["fit", "start"]).withColumn("moved", moved).select("fit", "start", *[F.when(F.col("moved"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in kept_too], "edge", "moved", off.alias("off")))
        any_moved, any_off = stepped.agg(F.max("moved"), F.max("off")).first()
        if any_off:
            lump = False  # an edge is in a summed-up shell: this step again, with all shells
            continue
        params, first, lump = stepped.drop("moved", "off"), False, True
        if not any_moved:
            break
    best = Window.partitionBy("fit").orderBy("logdet", "start")
    params = cut(params.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r"))
    inside = rows.join(hint(params), "fit").filter(_d2() <= chi2_quantile(0.025, _P))
    return cut(inside.groupBy("fit", "start").agg(*_sums()).mapInPandas(_solve(consistency(0.975, _P), floor), _PARAMS))


def _pooled(weight: float):
    """Mean and inverse of a group's estimate pooled with ``weight`` documents of its language's, that with as many of all documents', and that with usual prose."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def full(packed) -> np.ndarray:
            m = np.zeros((_P, _P))
            for v, (i, j) in zip(packed, _PAIRS):
                m[i, j] = m[j, i] = v
            return m

        for f in frames:
            out = []
            for r in f.to_dict("records"):
                mean, cov = np.array(_USUAL), np.eye(_P) * _USUAL_SD**2
                for level in ("a", "l", "s"):
                    if r[f"{level}_mean"] is not None:
                        n = float(r[f"{level}_n"])
                        mean = (n * np.array(r[f"{level}_mean"]) + weight * mean) / (n + weight)
                        cov = (n * np.linalg.inv(full(r[f"{level}_inv"])) + weight * cov) / (n + weight)
                inv = np.linalg.inv(cov)
                out.append((r["g"], mean.tolist(), [inv[i, j] for i, j in _PAIRS]))
            yield pd.DataFrame(out, columns=["g", "mean", "inv"])

    return run


def _judged(docs: DataFrame, alpha: float = ALPHA, support: float = SUPPORT, weight: float = WEIGHT, prior: float = PRIOR, floor: float = FLOOR) -> tuple[DataFrame, DataFrame]:
    """What ``scored`` returns, and each group's estimate: (g, mean, inv), a row for each language and source."""
    x = cut(statistics(docs, prior).withColumn("g", _group()).withColumn("l", F.coalesce("lang", F.lit("\0"))))
    xs = [f"x{k}" for k in range(_P)]
    worded = x.filter("x0 IS NOT NULL")
    fits = F.array(F.lit("a"), F.concat(F.lit("l:"), "l"), F.concat(F.lit("s:"), "g"))
    rows = cut(worded.select(F.explode(fits).alias("fit"), *xs))
    p = mcd(rows, support, floor)
    of = lambda level: p.select(F.col("fit").alias(f"{level}_fit"), *[F.col(c).alias(f"{level}_{c}") for c in ("mean", "inv", "n")])
    groups = worded.select("g", "l").distinct().withColumn("a_fit", F.lit("a")).withColumn("l_fit", F.concat(F.lit("l:"), "l")).withColumn("s_fit", F.concat(F.lit("s:"), "g"))
    for level in ("a", "l", "s"):
        groups = groups.join(of(level), f"{level}_fit", "left")
    estimates = cut(groups.mapInPandas(_pooled(weight), "g string, mean array<double>, inv array<double>"))
    out = x.join(checked_broadcast(estimates, _FITS), "g", "left").withColumn("d2", _d2())
    return out.select("doc_id", "text_key", "lang", "source", F.sqrt("d2").alias("distance"), _far(alpha).alias("rejected")), estimates


def _group() -> Column:
    """A name for language and source; nulls have one of their own."""
    return F.to_json(F.struct(F.coalesce("lang", F.lit("\0")).alias("l"), F.coalesce("source", F.lit("\0")).alias("s")))


def _far(alpha: float) -> Column:
    return F.coalesce(F.col("d2") > chi2_quantile(alpha, _P), F.col("signs"), F.lit(False))


def scored(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, text_key, lang, source, distance, rejected) of every document row.

    Each (lang, source) has its own estimate over all of its documents, pooled with ``weight`` documents of its language's, which is pooled
    likewise with all documents', and that with usual prose: one rule for groups and tables of any size, by which many documents speak for
    themselves and few lean on their like. A document is rejected if its distance is beyond the chi-square quantile of tail ``alpha``.

    Nulls: null lang and null source are groups of their own; null, empty and blank texts have null distance and aren't rejected; texts of
    signs without a word have null distance and are. A null doc_id is kept. Repeated rows and ties count as often as they occur and are
    decided alike. An empty table gives an empty result. Statistics of very long texts are of the whole text. Other columns are ignored.
    """
    return _judged(docs, **params)[0]


def _statistics_of(prior: float):
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        x = text_statistics(pa.array(texts, pa.string()), prior)
        return pd.Series([None if np.isnan(r[0]) else r for r in x])

    return of


@extra_aside("doc_id", "text", "lang", "source")
def kept(docs: DataFrame, max_broadcast: int = BROADCAST_ROWS, **params) -> DataFrame:
    """``docs`` without what ``scored`` rejects, with all columns, whatever their names.

    Up to ``max_broadcast`` rejected documents are taken out by their keys. Beyond that the statistics are computed a second time, in the
    pass that filters: so texts are never shuffled, however many there are; the same rows stay.

    Nulls: rows with null, empty or blank text stay; null lang and source are groups of their own; a null doc_id is as good as any. Texts of
    signs only go. Ties and repeated rows are decided alike. Texts of any length are read whole. An empty table gives an empty result.
    """
    scores, estimates = _judged(docs, **params)
    bad = cut(scores.filter("rejected").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("lang").alias("__lang"), F.col("source").alias("__source")).distinct())
    if bad.limit(max_broadcast + 1).count() > max_broadcast:
        xs = _statistics_of(params.get("prior", PRIOR))("text")
        at = docs.withColumn("g", _group()).withColumn("signs", _signs()).withColumn("xs", xs).join(checked_broadcast(estimates, _FITS), "g", "left")
        at = at.withColumns({f"x{k}": F.col("xs")[k] for k in range(_P)}).withColumn("d2", _d2())
        return at.filter(~_far(params.get("alpha", ALPHA))).select(*docs.columns)
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__key")) & docs["lang"].eqNullSafe(F.col("__lang")) & docs["source"].eqNullSafe(F.col("__source"))
    return docs.join(F.broadcast(bad), same, "left_anti")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The documents that stay, with their distance."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("NOT rejected").select("doc_id", "lang", "source", "distance")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE: dict[str, str] = {}
