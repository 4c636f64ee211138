"""Validation, profiling and cleaning.

Profiles are single aggregates unpivoted with ``stack``; exact quantiles come
from a distributed sort (global positions), never from a one-task buffer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ordering

# The raw sensor schema and the reference's clean-up mapping.
RAW_COLUMNS = [
    "UDI", "Product ID", "Type", "Air temperature [K]", "Process temperature [K]", "Rotational speed [rpm]",
    "Torque [Nm]", "Tool wear [min]", "Machine failure", "TWF", "HDF", "PWF", "OSF", "RNF",
]
DROP_COLUMNS = ["UDI", "Product ID"]
RENAMES = {
    "Air temperature [K]": "air_temp",
    "Process temperature [K]": "process_temp",
    "Rotational speed [rpm]": "rotational_speed",
    "Torque [Nm]": "torque",
    "Tool wear [min]": "tool_wear",
    "Machine failure": "machine_failure",
}
TYPE_LEVELS = ["L", "M", "H"]
REFERENCE_LEVEL = "H"
EXCLUDE_FROM_FEATURES = ["machine_failure", "TWF", "HDF", "PWF", "OSF", "RNF", "timestamp"]

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def schema_check(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Status of every expected / present column (metadata only, no scan)."""
    present = list(df.columns)
    rows = [(c, "present" if c in present else "missing") for c in expected]
    rows += [(c, "unexpected") for c in present if c not in expected]
    return df.sparkSession.createDataFrame(rows, "column string, status string")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column, one aggregate, unpivoted."""
    counts = df.agg(*[F.count_if(F.col(_q(c)).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return counts.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column, null_count)")


def target_profile(df: DataFrame, target: str = "machine_failure") -> DataFrame:
    """Rows, failures, share in percent and imbalance ratio normal / max(failures, 1)."""
    agg = df.agg(F.count(F.lit(1)).alias("total_rows"),
                 F.coalesce(F.sum(target), F.lit(0)).cast("long").alias("failures"))
    return agg.select(
        "total_rows", "failures", (F.col("total_rows") - F.col("failures")).alias("normal"),
        F.when(F.col("total_rows") > 0, F.round(F.col("failures") / F.col("total_rows") * 100, 4)).otherwise(F.lit(0.0)).alias("failure_pct"),
        F.round((F.col("total_rows") - F.col("failures")) / F.greatest(F.col("failures"), F.lit(1)), 4)
        .alias("imbalance_ratio"))


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Value counts, most frequent first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count")) \
        .orderBy(F.col("count").desc(), F.col("value"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``) of all columns in one job.

    Values are counted first (partial aggregation, so a frequent value is one row), then the counts
    are summed up in (column, value) order; the value at a position is the one whose range of
    positions holds it.  Returns one row per column: ``_c`` (index), ``q0``, ``q1``, ...
    """
    pieces = ", ".join(f"{i}, CAST({_q(c)} AS DOUBLE)" for i, c in enumerate(columns))
    long = df.selectExpr(f"stack({len(columns)}, {pieces}) AS (_c, v)").filter(F.col("v").isNotNull())
    counts = long.groupBy("_c", "v").agg(F.count(F.lit(1)).alias("_n"))
    cum = ordering.running_sums(counts, ["_n"], ["_c", "v"]).withColumnRenamed("_n_cum", "_end")
    # One row per column: where its values begin and how many there are.
    ranges = cum.groupBy("_c").agg(F.min(F.col("_end") - F.col("_n")).alias("_from"), F.max("_end").alias("_to")) \
        .select("_c", "_from", (F.col("_to") - F.col("_from")).alias("_total"))
    placed = cum.join(F.broadcast(ranges), "_c").withColumn("_end", F.col("_end") - F.col("_from"))
    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("_total") - 1) * F.lit(float(q))

        def at(position):
            return F.max(F.when((F.col("_end") - F.col("_n") <= position) & (position < F.col("_end")), F.col("v")))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        aggs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(f"q{i}"))
    return placed.groupBy("_c").agg(*aggs)


def numeric_describe(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """P5: count, mean, sample std, min, quartiles, max per numeric column (long form).

    ``approx=True`` uses ``percentile_approx`` (one pass, bounded memory) instead
    of the exact sort-based quartiles.
    """
    columns = list(columns or numeric_columns(df))
    base = df.agg(*[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(columns)],
                  *[F.avg(_q(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                  *[F.stddev_samp(_q(c)).alias(f"s{i}") for i, c in enumerate(columns)],
                  *[F.min(F.col(_q(c)).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)],
                  *[F.max(F.col(_q(c)).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)])
    qs = [0.25, 0.5, 0.75]
    if approx:
        parts = df.agg(*[F.percentile_approx(F.col(_q(c)).cast("double"), qs, 10000).alias(f"a{i}") for i, c in enumerate(columns)])
        quartiles = parts.selectExpr(f"stack({len(columns)}, " + ", ".join(f"{i}, a{i}[0], a{i}[1], a{i}[2]" for i in range(len(columns)))
                                     + ") AS (_c, q0, q1, q2)")
    else:
        quartiles = exact_quantiles(df, columns, qs)
    pieces = ", ".join(f"{i}, '{c}', n{i}, m{i}, s{i}, lo{i}, hi{i}" for i, c in enumerate(columns))
    out = base.selectExpr(f"stack({len(columns)}, {pieces}) AS (_c, column, count, mean, std, min, max)")
    return out.join(F.broadcast(quartiles), "_c", "left").select(
        "column", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), "max")


def column_value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, count) for every column, values as text; one shuffle."""
    columns = list(columns or df.columns)
    pieces = ", ".join(f"'{c}', CAST({_q(c)} AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pieces}) AS (column, value)")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P6 (second half): distinct values per column, from the value-count table."""
    return column_value_counts(df, columns).filter(F.col("value").isNotNull()) \
        .groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def one_hot(df: DataFrame, column: str, levels: Sequence[str] = TYPE_LEVELS, prefix: str | None = None,
            drop_level: str | None = REFERENCE_LEVEL, drop_source: bool = True) -> DataFrame:
    """Integer indicator per level; the reference level is dropped.

    The levels are an argument, so that the schema does not depend on the rows at hand: a level
    that does not occur gets a column of zeros, a value outside the levels gets zeros only.
    """
    prefix = prefix or column
    cols = [F.coalesce(F.col(column) == F.lit(lv), F.lit(False)).cast("int").alias(f"{prefix}_{lv}") for lv in levels if lv != drop_level]
    out = df.select("*", *cols)
    return out.drop(column) if drop_source else out


def clean(df: DataFrame, drop: Sequence[str] = DROP_COLUMNS, renames: dict | None = None,
          type_column: str = "Type", type_levels: Sequence[str] = TYPE_LEVELS) -> DataFrame:
    """P7 + P8 + P9: drop identifiers, rename to safe names, one-hot the type."""
    renames = RENAMES if renames is None else renames
    out = df.drop(*[c for c in drop if c in df.columns])
    out = out.withColumnsRenamed({k: v for k, v in renames.items() if k in out.columns})
    if type_column in out.columns:
        out = one_hot(out, type_column, type_levels)
    return out


def exclude_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDE_FROM_FEATURES) -> DataFrame:
    """Leakage / exclude projection."""
    return df.drop(*[c for c in exclude if c in df.columns])


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Fill nulls of numeric columns with the column median (exact by default)."""
    columns = list(columns or numeric_columns(df))
    if approx:
        medians = df.agg(*[F.percentile_approx(F.col(_q(c)).cast("double"), 0.5, 10000).alias(f"_m{i}") for i, c in enumerate(columns)])
    else:
        medians = exact_quantiles(df, columns, [0.5]).agg(*[F.max(F.when(F.col("_c") == i, F.col("q0"))).alias(f"_m{i}") for i in range(len(columns))])
    kinds = {c: df.schema[c].dataType for c in columns}
    return df.crossJoin(F.broadcast(medians)).select(*[  # one row
        F.coalesce(F.col(_q(c)), F.col(f"_m{columns.index(c)}").cast(kinds[c])).alias(c) if c in kinds else F.col(_q(c)) for c in df.columns])


def coerce_types(df: DataFrame, numeric: Sequence[str], integer: Sequence[str] = ()) -> DataFrame:
    """Text -> double with bad values -> NULL (``try_cast``); integer columns truncated."""
    cols = []
    for c in df.columns:
        if c in numeric:
            cols.append(F.expr(f"try_cast({_q(c)} AS DOUBLE)").alias(c))
        elif c in integer:
            cols.append(F.expr(f"try_cast(try_cast({_q(c)} AS DOUBLE) AS INT)").alias(c))
        else:
            cols.append(F.col(_q(c)))
    return df.select(*cols)


def dedup_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop duplicate rows (optionally on a key subset)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def dedup_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P13 counts: rows before, after and removed, in one job."""
    keys = list(subset or df.columns)
    per_key = df.groupBy(*[F.col(_q(c)) for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.sum("_n").cast("long").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")) \
        .withColumn("removed", F.col("rows_before") - F.col("rows_after"))
