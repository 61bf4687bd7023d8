"""Helpers shared by the corpus operators: reading columns, slicing Arrow batches, shared scratch tables."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship, tidy

#: Bounds of one Arrow batch: bytes for whole texts, rows for narrow ones. Spark's own are 64 MB and 10,000 rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "32768")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its JVM hold of one batch, where the session has not chosen a bound; ships the package."""
    ship(spark)
    tidy(spark)
    for key, (default, own) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory of this Python worker back to the system, so that a worker that waits holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, with its memory released when a task ends; workers are used again by other stages."""

    @functools.wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


#: Paths handed out by ``scratch`` in this process and not yet dropped.
_made: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path below the folder that the cluster names in ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local master, as in tests,
    gets a local folder that the session remembers; any other has no folder that all its
    executors see, which is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", root)
    small_batches(spark)
    _made.append(f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, *partition_hint: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage: an executor that goes away later costs nothing that was
    written, unlike cached blocks or local checkpoints.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_made() -> int:
    """How many scratch paths were handed out and not dropped; see ``drop_scratch``."""
    return len(_made)


def drop_scratch(spark: SparkSession, since: int) -> None:
    """Deletes the scratch tables made after the first ``since`` but for the last one, which a caller goes on with."""
    for path in _made[since:-1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)


def slices(batches: Iterator[pa.RecordBatch], column: str | int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` (name or place) holds about ``max_bytes`` in each (one row at least), without copying."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


#: Bits of the maps below: 8 MB, however many values there are. A full map saves nothing and loses nothing.
MAP_BITS = 1 << 26


def bit_map(df: DataFrame, column: str) -> np.ndarray:
    """Bit ``value mod MAP_BITS`` of every value of a long column; at most MAP_BITS / 64 words reach the driver.

    It says which values may be in ``df``, and only saves shuffling rows that are not:
    an exact join has to follow.
    """
    words = df.selectExpr(f"CAST(pmod({column}, {MAP_BITS}) DIV 64 AS INT) AS word", f"shiftleft(1L, CAST(pmod({column}, 64) AS INT)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bit_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (MAP_BITS - 1)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
