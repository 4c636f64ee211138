"""Work on bounded blocks of rows: hot groups are cut into parts and compared part with part."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import utf8
from .common import tidy


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from batches that are sorted by it; holds one run at a time."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(k)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            if kept and k[a] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = k[a]
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def by_block(rows: DataFrame, key: str, work: Callable, schema: str, n: int | None = None) -> DataFrame:
    """Bring the rows of a (bounded) block together and run ``work(table) -> record batches`` on each."""
    def run(batches):
        for table in runs(batches, key):
            yield from work(table)

    dealt = rows.repartition(n, key) if n else rows.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(tidy(run), schema)


def flat(table: pa.Table, column: str, kind) -> np.ndarray:
    """The packed numbers of a binary column, of all rows in a row, without a Python object per row."""
    return utf8(table.column(column))[0].view(kind)


def sizes(table: pa.Table, column: str, kind) -> np.ndarray:
    """How many packed numbers each row of a binary column holds."""
    return np.diff(utf8(table.column(column))[1]) // np.dtype(kind).itemsize


def paired_blocks(rows: DataFrame, group: str, row_id: str, block_rows: int) -> DataFrame:
    """Give every row the blocks in which it meets the rest of its group.

    A group of at most ``block_rows`` rows is one block.  A larger one is cut by a hash of
    ``row_id`` into parts of about that many rows, and each pair of parts is a block.  Adds
    ``_block`` (long), ``_part``, ``_left`` and ``_right``: parts that meet in the block.
    """
    large = (rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
             .select(F.col(group).alias("_g"), F.ceil(F.col("_n") / block_rows).cast("int").alias("_parts")))
    cut = (rows.join(large, F.col(group) == F.col("_g"), "left").drop("_g")
           .withColumn("_parts", F.coalesce("_parts", F.lit(1)))
           .withColumn("_part", F.expr(f"cast(pmod(xxhash64({row_id}, 7), _parts) as int)"))
           .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))))
    return (cut.withColumn("_left", F.least("_part", "_other")).withColumn("_right", F.greatest("_part", "_other"))
            .withColumn("_block", F.xxhash64(group, "_left", "_right")).drop("_other", "_parts"))


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from every index of a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, near)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
