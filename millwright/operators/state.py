"""Keyed-state changes (U1-U8) as pure functions (state, changes) -> new state.

Plain Parquet tables have no MERGE, so each change is a union / join plus a
keep-latest aggregate, and the result is written as a new version folder by
``commit_version`` (never over the input being read).  Keep-latest uses
``max_by`` aggregation (partial aggregation on the map side) rather than a
per-key window, so one hot key does not end up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def keep_latest(df: DataFrame, keys: Sequence, order: Sequence[str]) -> DataFrame:
    """Newest row per key by ``order`` (all columns kept)."""
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key_names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    keyed = df.select("*", *[c.alias(n) for c, n in zip(key_cols, key_names) if n.startswith("_k")])
    others = [c for c in df.columns]
    agg = keyed.groupBy(*key_names).agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return agg.select(*[F.col(f"_r.{c}").alias(c) for c in others])


def upsert_predictions(state: DataFrame, changes: DataFrame, key_unit: str = "second",
                       ts_col: str = "timestamp", arrival: str = "id") -> DataFrame:
    """(truncated timestamp, machine) conflict -> the later arrival replaces.

    A change replaces a stored row whatever their ids; ``arrival`` decides among changes only.
    """
    both = state.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    return keep_latest(both, [F.date_trunc(key_unit, F.col(ts_col)), "machine_id"], ["_src", arrival]).drop("_src")


def one_change(changes: DataFrame, order: Sequence[str], key: str = "machine_id") -> DataFrame:
    """The last change per key by ``order`` (then by all columns), so that a join multiplies nothing."""
    rest = [c for c in changes.columns if c not in order and c != key]
    return keep_latest(changes.filter(F.col(key).isNotNull()), [key], [*order, *rest])


def registry_upsert(registry: DataFrame, readings: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Insert unknown machines (created = first reading), then set last_seen.

    ``registry`` columns: machine_id, created_timestamp, last_seen, status, location, type.
    """
    seen = readings.groupBy("machine_id").agg(F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"))
    j = registry.join(seen, "machine_id", "full_outer")
    return j.select(
        "machine_id",
        F.coalesce("created_timestamp", "_first").alias("created_timestamp"),
        F.greatest("last_seen", "_last").alias("last_seen"),
        F.coalesce("status", F.lit("OPERATIONAL")).alias("status"),
        "location", "type")


def resolve_failures(failures: DataFrame, resolutions: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Mark the open failures (prediction 1) of resolved machines (flag, time, by, notes).

    The machine's last resolution counts, and only for failures logged up to it, so that a replay
    does not close later ones.
    """
    last = one_change(resolutions.select("machine_id", "resolved_timestamp", "resolved_by", "notes"), ["resolved_timestamp"])
    r = last.select("machine_id", F.struct("resolved_timestamp", "resolved_by", "notes").alias("_r"))
    hit = ((F.col("resolved") == 0) & (F.col("prediction") == 1) & F.col("_r").isNotNull()
           & (F.col(ts_col) <= F.col("_r.resolved_timestamp")))
    new = {"resolved": F.lit(1), **{c: F.col(f"_r.{c}") for c in ("resolved_timestamp", "resolved_by", "notes")}}
    return failures.join(r, "machine_id", "left").select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in failures.columns])


def resolution_upsert(registry: DataFrame, new: DataFrame, arrival: str = "resolved_timestamp") -> DataFrame:
    """U4: insert-or-replace by machine; a replacement resets ``reactivated`` to 0."""
    incoming = new.select("machine_id", "resolved_timestamp", "resolved_by", "notes",
                          F.lit(0).alias("reactivated"), F.lit(None).cast("timestamp_ntz").alias("reactivated_timestamp"),
                          F.lit(1).alias("_src"))
    current = registry.select("machine_id", "resolved_timestamp", "resolved_by", "notes", "reactivated",
                              "reactivated_timestamp", F.lit(0).alias("_src"))
    latest = keep_latest(current.unionByName(incoming), ["machine_id"], ["_src", arrival])
    return latest.drop("_src")


def resolved_machines(failures: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose machine is resolved and not reactivated (left-semi join)."""
    active = registry.filter(F.col("reactivated") == 0).select("machine_id")
    return failures.join(active, "machine_id", "left_semi")


def _purged(now, days: int):
    cutoff = F.timestamp_add("DAY", F.lit(-int(days)), now if not isinstance(now, str) else F.lit(now).cast("timestamp_ntz"))
    return F.coalesce((F.col("resolved") == 1) & (F.col("resolved_timestamp") < cutoff), F.lit(False))


def purge_resolved(failures: DataFrame, now, days: int) -> DataFrame:
    """Drop resolved rows whose resolution is older than ``days``; NULL times stay."""
    return failures.filter(~_purged(now, days))


def purge_count(failures: DataFrame, now, days: int) -> DataFrame:
    """How many rows ``purge_resolved`` drops and keeps."""
    old = _purged(now, days)
    return failures.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def registry_set_maintenance(registry: DataFrame, schedule: DataFrame, scheduled_at) -> DataFrame:
    """next_scheduled_maintenance = {date, type, scheduled_at} for scheduled machines.

    Of several entries of a machine the earliest date counts; machines without one keep theirs.
    """
    entries = schedule.select("machine_id", F.struct(F.col("scheduled_date").alias("date"), F.col("maintenance_type").alias("type")).alias("_e"))
    s = entries.filter("machine_id is not null").groupBy("machine_id").agg(F.min("_e").alias("_e"))
    nxt = F.when(F.col("_e").isNotNull(), F.struct(F.col("_e.date").alias("date"), F.col("_e.type").alias("type"), scheduled_at.alias("scheduled_at")))
    if "next_scheduled_maintenance" in registry.columns:
        nxt = F.coalesce(nxt, F.col("next_scheduled_maintenance"))
    return registry.join(s, "machine_id", "left").withColumn("next_scheduled_maintenance", nxt).drop("_e")


def registry_set_status(registry: DataFrame, changes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """U8: status from the change set when present; the last change by ``order`` counts."""
    c = one_change(changes.select("machine_id", "status", *order), order).select("machine_id", F.col("status").alias("_s"))
    return registry.join(c, "machine_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


class VersionedTable:
    """A table as numbered version folders below one root; readers see the last complete one.

    A version is complete when the writer's success mark is in its folder, so a reader moves from
    one version to the next at once, and a failed commit leaves the current version as it is.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        mark = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(mark(f"{self.root}/{n}/_SUCCESS")))

    def current_version(self) -> int:
        """Number of the last complete version, 0 if there is none."""
        return max(self._versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{version or self.current_version()}")

    def commit(self, df: DataFrame, expected: int | None = None) -> int:
        """Write the next version; with ``expected``, only if that is still the current one."""
        current = self.current_version()
        if expected is not None and expected != current:
            raise ValueError(f"version {current} is current, not {expected}")
        df.write.mode("overwrite").parquet(f"{self.root}/v{current + 1}")
        return current + 1


def commit_version(df: DataFrame, table_root: str | None = None, name: str = "state") -> DataFrame:
    """Commit ``df`` as the next version of a table and return that version as read back."""
    table = VersionedTable(df.sparkSession, table_root or scratch_path(df.sparkSession, name))
    return table.read(table.commit(df))
