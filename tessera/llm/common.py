"""Helpers that the operators of this subpackage share: tables, stage storage, hashing of text slices."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts in which the rows of one key meet before they meet as a whole; at most 63.
SALTS = 32
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 2000
#: Bytes of text that one vectorised step handles at once in a Python worker.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one if it is unset, but only where
    driver and executors are one process."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = getattr(sc, "_tessera_dir", None)
        if place is None:
            place = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
            sc._tessera_dir = place
            sc.setCheckpointDir(place)
    return place


def short_batches(spark: SparkSession) -> None:
    """Hold the session to BATCH_ROWS rows in an Arrow batch, so that JVM and Python workers need little room for it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _written(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tessera_written"):
        sc._tessera_written = []
    return sc._tessera_written


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    Shuffle files go as soon as it is written; else they stay until the driver's JVM happens to collect its garbage.
    """
    spark = df.sparkSession
    short_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)
    _written(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(spark: SparkSession, keep: DataFrame | None = None, since: int = 0) -> None:
    """Delete what stored() has written after the first `since` tables, but for the table `keep`."""
    paths, jvm = _written(spark), spark.sparkContext._jvm
    for path in paths[since:]:
        if keep is None or path != keep._tessera_path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            paths.remove(path)


def written(spark: SparkSession) -> int:
    """How many tables of stored() there are."""
    return len(_written(spark))


def salt(column: Column) -> Column:
    """A row's part among those of its key."""
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def parts(column: Column) -> Column:
    """Aggregate: which parts a key has, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), column))


def each_part(df: DataFrame, bits: str, to: str) -> DataFrame:
    """A row for each of the parts that the bits name, SALTS at most, instead of the bits."""
    every = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(bits, i) == 1)
    return df.withColumn(to, F.explode(every)).drop(bits)


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns named, whatever else the table holds, for an Arrow function."""
    short_batches(df.sparkSession)
    return df.select(*(df[c] for c in columns))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about limit bytes of text; a longer text stays whole, alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < batch.num_rows:
        base = run[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(run, base + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def lean(run: Callable) -> Callable:
    """A mapInArrow function that hands freed memory back at its end, so that idle Python workers stay small."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return whole


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1, for every i in turn."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
