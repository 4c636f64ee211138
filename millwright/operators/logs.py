"""Views of prediction and failure logs, and columns given to tables without them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import ordering

FAILURE_COLUMNS = ("id", "timestamp", "risk_level", "failure_probability", *rules.SENSORS)
LOG_COLUMNS = ("ts", "event_id", "risk_level", "failure_probability", *rules.SENSORS)


def of_risk(log: DataFrame, *levels: str) -> DataFrame:
    """Rows of these risk levels; a row without level is in none."""
    return log.filter(F.col("risk_level").isin(*levels))


def of_machine(log: DataFrame, *machines) -> DataFrame:
    """Rows of these machines, a filter that reaches the scan."""
    return log.filter(F.col("machine_id").isin(*machines))


def unresolved_failures(failures: DataFrame) -> DataFrame:
    """Predicted failures with ``resolved`` 0, all of them; a null mark counts as resolved by nobody and is left out."""
    return failures.filter((F.col("resolved") == 0) & (F.col("prediction") == 1))


def failures_of_log(log: DataFrame) -> DataFrame:
    """P20: every predicted failure of a log, in its report's columns; where the log has ``resolved``, only rows without that mark."""
    rows = log.filter(F.col("prediction") == 1)
    if "resolved" in log.columns:
        rows = rows.filter(~F.coalesce(F.col("resolved").cast("boolean"), F.lit(False)))
    return rows.select(F.col("ts").alias("timestamp"), "machine_id", "risk_level", F.col("failure_probability").alias("avg_risk_score"),
                       *rules.SENSORS)


def _one_per(df: DataFrame, key: str, keep: Sequence[str], pick) -> DataFrame:
    return df.groupBy(key).agg(pick(F.struct(*keep)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in keep])


def newest_failure_per_machine(failures: DataFrame, keep: Sequence[str] = FAILURE_COLUMNS, order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """The newest unresolved failure of each machine, by an aggregate with partial maxima; rows without time are oldest."""
    return _one_per(unresolved_failures(failures), "machine_id", keep, lambda r: F.max_by(r, F.struct(*order)))


def oldest_failure_per_machine(log: DataFrame, keep: Sequence[str] = LOG_COLUMNS, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The first predicted failure of each machine in log order; rows without time are first."""
    return _one_per(log.filter(F.col("prediction") == 1), "machine_id", keep, lambda r: F.min_by(r, F.struct(*order)))


def sample_per_class(df: DataFrame, keep: Sequence[str], order: Sequence[str] = ("ts", "event_id"), test_size: float = 0.2,
                     label: str = "machine_failure") -> DataFrame:
    """The first row of each class in the later ``test_size`` part of the table."""
    later = ordering.time_split(df, list(order), test_size).filter(F.col("split") == "test")
    return _one_per(later, label, keep, lambda r: F.min_by(r, F.col("row_position")))


def with_synthetic_time(df: DataFrame, order: Sequence[str], start: str = "2024-01-01 00:00:00", step_minutes: int = 1,
                        name: str = "timestamp") -> DataFrame:
    """P10: one row every ``step_minutes`` from ``start``, by position in ``order``; an older column ``name`` is replaced."""
    placed = ordering.row_position(df, list(order), name="_place")
    time = F.timestamp_add("MINUTE", F.col("_place") * step_minutes, F.lit(start).cast("timestamp_ntz"))
    return placed.withColumn(name, time).drop("_place")


def with_machines(df: DataFrame, order: Sequence[str], machines: int = 50, id_format: str = "MACHINE_%04d") -> DataFrame:
    """Rows dealt round to ``machines`` machines from 1, and a numbered ``row_id``, by position in ``order``."""
    placed = ordering.row_position(df, list(order), name="_place")
    return placed.select(*[c for c in df.columns if c not in ("machine_id", "row_id")],
                         (F.pmod(F.col("_place"), F.lit(machines)) + 1).alias("machine_id"), F.format_string(id_format, F.col("_place") + 1).alias("row_id"))
