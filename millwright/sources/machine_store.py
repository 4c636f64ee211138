"""Tables for lookups by machine (S13-S15, JN1): sorted by machine, in few files, with bloom filters.

The file count follows the bytes and not the fleet: rows are dealt by ranges of the machine and
small ranges are put together by adaptive execution.  A lookup reads only the row groups that may
hold its machines, told by their smallest and largest machine and, for machines missing in
between, by a bloom filter per row group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.features import retain_last_n

KEY = "machine_id"
ROW_GROUP_BYTES = 8 << 20
KEYS_PER_ROW_GROUP = 100_000
MAX_LITERALS = 1000
IN_LIST = 10  # spark.sql.parquet.pushdown.inFilterThreshold: longer lists reach the scan as a range only


def write_by_machine(df: DataFrame, path: str, key: str = KEY, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Parquet sorted by ``key``; rows with a null key are kept (first), an existing table is replaced."""
    (df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite")
     .option("parquet.block.size", row_group_bytes)
     .option(f"parquet.enable.dictionary#{key}", False)  # a chunk with a full dictionary gets no bloom filter
     .option(f"parquet.bloom.filter.enabled#{key}", True)
     .option(f"parquet.bloom.filter.expected.ndv#{key}", KEYS_PER_ROW_GROUP)
     .parquet(path))
    return path


def among(key: str, values: Sequence) -> Column:
    """``key`` is one of ``values``, in lists that the scan takes over whole."""
    lists = [F.col(key).isin(*values[i:i + IN_LIST]) for i in range(0, len(values), IN_LIST)]
    return reduce(or_, lists) if lists else F.lit(False)


def lookup(table: DataFrame, wanted: DataFrame, key: str = KEY, max_literals: int = MAX_LITERALS) -> DataFrame:
    """Rows of ``table`` whose machine is in ``wanted``; null machines are found by nothing.

    Up to ``max_literals`` machines (counted first, by reading at most one more) become a filter of the
    scan, which prunes row groups; beyond that the same rows come from a semi join.
    """
    machines = wanted.select(key).filter(F.col(key).isNotNull()).distinct()
    found = [r[0] for r in machines.limit(max_literals + 1).collect()]
    if len(found) <= max_literals:
        return table.filter(among(key, sorted(found)))
    return table.join(machines, key, "left_semi")


def prediction_lists(scored: DataFrame, keep_last: int, ts_col: str = "ts",
                     order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Per machine the newest ``keep_last`` predictions, oldest first; the retention bounds each list."""
    kept = retain_last_n(scored, keep_last, order, [KEY])
    record = F.struct(F.col("prediction"), F.col("failure_probability"), F.col("normal_probability"), F.col("risk_level"),
                      F.struct(*rules.SENSORS).alias("sensor_data"), F.col(ts_col).alias("timestamp"), F.col(order[-1]).alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], record.alias("r"))))
    return kept.groupBy(KEY).agg(ordered["r"].alias("predictions"))


def last_predictions(lists: DataFrame, limit: int) -> DataFrame:
    """One row per prediction, the newest ``limit`` of each list; ``idx`` is the place in the whole list."""
    skipped = F.greatest(F.size("predictions") - F.lit(limit), F.lit(0))
    tail = lists.select(KEY, skipped.alias("_skipped"), F.slice("predictions", skipped + 1, F.lit(limit)).alias("_tail"))
    rows = tail.select(KEY, "_skipped", F.posexplode("_tail").alias("_i", "r"))
    return rows.select(KEY, (F.col("_skipped") + F.col("_i")).alias("idx"), "r.*")


@dataclass
class MachineStore:
    """Registry, statistics and newest predictions of a fleet below one root, each by machine."""
    spark: SparkSession
    root: str

    def write(self, registry: DataFrame, statistics: DataFrame, scored: DataFrame, keep_last: int = 1000) -> "MachineStore":
        write_by_machine(registry, f"{self.root}/registry")
        write_by_machine(statistics, f"{self.root}/statistics")
        write_by_machine(prediction_lists(scored, keep_last), f"{self.root}/predictions")
        return self

    def table(self, name: str) -> DataFrame:
        """``registry``, ``statistics`` or ``predictions``."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def records(self, wanted: DataFrame, recent: int = 200, max_literals: int = MAX_LITERALS) -> DataFrame:
        """JN1 / S15: registry entry, statistics and the ``recent`` newest predictions (newest first) of each wanted machine.

        A wanted machine without registry entry gives no row; one without predictions has null statistics and a null list.
        """
        def part(name):
            return lookup(self.table(name), wanted, max_literals=max_literals)
        newest = F.reverse(F.slice("predictions", F.greatest(F.size("predictions") - F.lit(recent), F.lit(0)) + 1, F.lit(recent)))
        return (part("registry").join(part("statistics"), KEY, "left")
                .join(part("predictions").select(KEY, newest.alias("recent_predictions")), KEY, "left"))
