"""Shared helpers of the training-data operators: tables, cut lineage, worker caches, slices."""

from __future__ import annotations

import ctypes
import functools
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation, and two readers of
    the result see the same rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows and bytes of one Arrow batch where rows hold whole texts or packed lists.
TEXT_ROWS = 1000
TEXT_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Let this session send rows to Python in batches of at most ``TEXT_ROWS`` rows and ``TEXT_BYTES``.

    A batch is held by the JVM and by the Python worker at once; with whole texts in its rows the
    defaults make batches of tens of megabytes.  Plans read the limits when they run, so they stay
    set for the session; smaller settings are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = str(spark.conf.get(key)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fragments_of_bytes(texts: DataFrame, column: str, each: int) -> int:
    """Number of fragments of about ``each`` bytes of text, at least one per shuffle partition."""
    size = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-int(size) // each))


def tidy(run: Callable) -> Callable:
    """Give freed memory back to the system when a task of ``run`` ends; workers are used again."""
    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):    # another C library: it keeps what it freed
                pass
    return tidied


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by its tasks."""
    holder = sys.modules.setdefault("_millwright_worker_cache", types.ModuleType("_millwright_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def slices(batch: pa.RecordBatch, text: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``max_bytes`` of ``text``, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    start, used = 0, 0
    for i, size in enumerate(sizes):
        if i > start and used + size > max_bytes:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += int(size)
    yield batch.slice(start, n - start)


