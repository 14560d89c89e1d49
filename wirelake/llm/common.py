"""What the corpus operators share: the shared folder, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a broadcast side may have; beyond it the join shuffles. At some 40 bytes a row this is 40 MB.
BROADCAST_ROWS = 1_000_000
#: Bits of a sieve for each of its keys, and in all at most (16 MB): with more keys more rows pass that have none, never fewer that have one.
SIEVE_BITS, SIEVE_MOST = 64, 1 << 27


#: Bytes of an Arrow batch between the JVM and Python: a running task holds some of them outside the heap and in its worker.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes up to which Spark may broadcast a join's side on its own while something is cut: the driver holds what is broadcast several times over.
AUTO_BROADCAST = 1 << 18
_AUTO = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
#: glibc's malloc_trim, None with other C libraries.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _aside(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns that aren't wanted under names that no operator uses."""
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        names.append(c if c in wanted and c not in seen else f"wl_extra_{i}")
        seen.add(c)
    return df.toDF(*names)


def only(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns, whatever others there are, also such as differ in case alone."""
    return _aside(df, wanted).select(*wanted)


def extra_aside(*wanted: str) -> Callable:
    """For functions from a table to some of its rows: what they name their own columns can't clash with the table's extra ones."""

    def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(f)
        def run(docs: DataFrame, *args, **params) -> DataFrame:
            return f(_aside(docs, wanted), *args, **params).toDF(*docs.columns)

        return run

    return wrap


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named in ``spark.checkpoint.dir``.

    Only a local master may go without the setting: then a temporary folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="wirelake-")
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside gets Arrow batches of at most ``BATCH_BYTES`` and broadcasts of ``AUTO_BROADCAST`` unless it asks for them; the
    session's settings come back afterwards."""
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    inside = {_BATCH: str(BATCH_BYTES)} | dict.fromkeys(_AUTO, str(min(most, AUTO_BROADCAST)))
    before = {k: spark.conf.get(k, None) for k in inside}
    for k, v in inside.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared folder, forget the lineage."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else without (the join then shuffles).

    ``df`` should be cheap to read twice, so a cut one.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Sieves that the innermost ``sieves_given_back`` destroys.
_open: list[ExitStack] = []


@contextmanager
def sieves_given_back() -> Iterator[None]:
    """Sieves that are made inside are destroyed at its end; what uses them has to be computed by then."""
    with ExitStack() as held:
        _open.append(held)
        try:
            yield
        finally:
            _open.pop()


def _bits(keys: DataFrame, on: tuple[str, ...], level: int = 0) -> tuple[int, Callable[[np.ndarray], np.ndarray]]:
    """(size, there): how many places there are, and which are some key's. Another ``level`` is another hash."""
    size = min(SIEVE_MOST, max(1 << 15, 1 << (SIEVE_BITS * keys.count() - 1).bit_length()))
    bits = np.zeros((size >> 15, 4096), np.uint8)
    for r in keys.select(_place(size, level, *on).alias("p")).groupBy(F.shiftright("p", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32_767))).alias("bits")).toLocalIterator():
        bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(bits.reshape(-1))
    if _open:
        _open[-1].callback(sent.destroy)

    def there(places: np.ndarray) -> np.ndarray:
        return (sent.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)

    return size, there


def _place(size: int, level: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), *columns), F.lit(size))


def _passes(there: Callable[[np.ndarray], np.ndarray]):
    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        return pd.Series(there(places.to_numpy()))

    return passes


def sieve(keys: DataFrame, *on: str) -> tuple[Column, Callable[[np.ndarray], np.ndarray]]:
    """(place, there): the place of a row with columns ``on``, and which places are some key's; few others are, so an exact join has to follow.

    The driver holds bits of the keys' hashes only, of bounded size, where broadcast rows take it some hundreds of bytes each for a while.
    ``keys`` should be cheap to read twice, so a cut one; the columns' types have to be the same on both sides.
    """
    size, there = _bits(keys, on)
    return _place(size, 0, *on), there


def sifted(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """The rows of ``df`` that have a key of ``keys`` in columns ``on``, and few others: see ``sieve``."""
    place, there = sieve(keys, *on)
    return df.filter(_passes(there)(place))


def told_apart(ours: DataFrame, others: DataFrame, *on: str) -> Callable[..., Column] | None:
    """A column of columns like ``on``: whether they are a key of ``ours``; right for all keys of ``ours`` and of ``others``, which share none.

    Bits of the hashes of ``ours`` let pass some of ``others``; bits of these let pass some of ``ours``, and so on by other hashes until none
    is left. So the driver holds bits of bounded size, and rows with such a key needn't be shuffled to be told apart. None if ``ours`` are more
    keys than there are bits: then only an exact join tells.
    """
    if ours.count() > SIEVE_MOST:
        return None
    levels: list[tuple[int, Callable[[np.ndarray], np.ndarray]]] = []
    inside, outside = ours, others
    while not inside.isEmpty():
        size, there = _bits(inside, on, len(levels))
        inside, outside = cut(outside.filter(_passes(there)(_place(size, len(levels), *on)))), inside
        levels.append((size, there))
    tests = [t for _, t in levels]

    @F.pandas_udf("boolean")
    def is_ours(*places: pd.Series) -> pd.Series:
        out = np.zeros(len(places[0]), bool)
        for t, p in zip(reversed(tests), reversed(places)):
            out = t(p.to_numpy()) & ~out  # passes, and the next level doesn't say that it does so by chance
        return pd.Series(out)

    return lambda *columns: is_ours(*[_place(size, i, *columns) for i, (size, _) in enumerate(levels)]) if levels else F.lit(False)


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """Delete the path when the driver's interpreter ends, if the session is still there."""

    def gone() -> None:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete_path(spark, path)

    atexit.register(gone)
    return path


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Compute once and keep as Parquet in the shared folder, for tables too large for a checkpoint's uncompressed rows."""
    spark = df.sparkSession
    path = delete_at_exit(spark, scratch_path(spark, name))
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker has freed to the system: allocators keep it otherwise, in each of an executor's workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def chunks_of_rows(offsets, most: int):
    """Ranges [i, j) of rows whose bytes come to ``most`` at the utmost; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= most:
            j += 1
        yield i, j
        i = j
