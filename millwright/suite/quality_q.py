"""Registered validation / cleaning / projection / filter queries (P*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators import cleaning, logs
from ..operators.features import MODEL_FEATURES
from ..plans import scoring
from .base_sql import with_views

SENS = ", ".join(rules.SENSORS)


def raw_frame(spark, d):
    """The reference's raw sensor shape, derived from the sensor view."""
    s = fx.sensors_with_flags(spark, d)
    return s.select(
        F.col("event_id").alias("UDI"), F.concat(F.col("type"), F.col("machine_id").cast("string")).alias("Product ID"),
        F.col("type").alias("Type"), F.col("air_temp").alias("Air temperature [K]"),
        F.col("process_temp").alias("Process temperature [K]"), F.col("rotational_speed").alias("Rotational speed [rpm]"),
        F.col("torque").alias("Torque [Nm]"), F.col("tool_wear").alias("Tool wear [min]"),
        F.col("machine_failure").alias("Machine failure"), "TWF", "HDF", "PWF", "OSF", "RNF")


RAW_SQL = """SELECT event_id AS "UDI", type || CAST(machine_id AS VARCHAR) AS "Product ID", type AS "Type",
  air_temp AS "Air temperature [K]", process_temp AS "Process temperature [K]",
  rotational_speed AS "Rotational speed [rpm]", torque AS "Torque [Nm]", tool_wear AS "Tool wear [min]",
  machine_failure AS "Machine failure", TWF, HDF, PWF, OSF, RNF FROM flagged"""

NULLS_SQL = "SELECT event_id, machine_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE air_temp END AS air_temp, " \
            "process_temp, rotational_speed, torque, tool_wear, type, machine_failure FROM sensors"

EVENTS_EXPECTED = ["event_id", "ts", "machine_id", "event_type", "value", "props"]


def q_schema_check(spark, d):
    return cleaning.schema_check(fx.table(spark, d, "events"), EVENTS_EXPECTED)


SQL_SCHEMA = f"""
WITH exp(column_name) AS (VALUES {', '.join(f"('{c}')" for c in EVENTS_EXPECTED)}),
act AS (SELECT column_name FROM information_schema.columns WHERE table_name = 'events')
SELECT e.column_name AS "column", CASE WHEN a.column_name IS NULL THEN 'missing' ELSE 'present' END AS status
FROM exp e LEFT JOIN act a ON e.column_name = a.column_name
UNION ALL
SELECT column_name AS "column", 'unexpected' AS status FROM act WHERE column_name NOT IN (SELECT column_name FROM exp)"""


def q_null_profile(spark, d):
    return cleaning.null_profile(fx.with_nulls(spark, d))


def _null_sql():
    cols = ["event_id", "machine_id", "ts", "air_temp", "process_temp", "rotational_speed", "torque", "tool_wear",
            "type", "machine_failure"]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS null_count FROM nulls" for c in cols)
    return with_views(f", nulls AS ({NULLS_SQL})\n{parts}", "sensors")


def q_target_profile(spark, d):
    return cleaning.target_profile(fx.sensors(spark, d))


SQL_TARGET = with_views("""
SELECT count(*) AS total_rows, CAST(sum(machine_failure) AS BIGINT) AS failures,
       count(*) - CAST(sum(machine_failure) AS BIGINT) AS normal,
       round(sum(machine_failure) / count(*) * 100, 4) AS failure_pct,
       round((count(*) - sum(machine_failure)) / greatest(sum(machine_failure), 1), 4) AS imbalance_ratio
FROM sensors""", "sensors")


def q_category_counts(spark, d):
    return cleaning.category_counts(fx.sensors(spark, d), "type")


SQL_CATEGORY = with_views("SELECT type AS value, count(*) AS count FROM sensors GROUP BY type", "sensors")

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_numeric_describe(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    out = cleaning.numeric_describe(li)
    return out.select("column", "count", *[F.round(c, 6).alias(c) for c in
                                           ["mean", "std", "min", "p25", "p50", "p75", "max"]])


SQL_DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in LI_NUM)

PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def q_column_value_counts(spark, d):
    return cleaning.column_value_counts(spark.read.parquet(f"{d}/part.parquet"))


SQL_VALUE_COUNTS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM part GROUP BY {c}"""
    for c in PART_COLS)


def q_distinct_counts(spark, d):
    return cleaning.distinct_counts(spark.read.parquet(f"{d}/orders.parquet"))


SQL_DISTINCT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values FROM orders"""
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])


def q_one_hot(spark, d):
    s = fx.sensors(spark, d).select("event_id", "type")
    return cleaning.one_hot(s, "type", prefix="Type", drop_source=False)


SQL_ONE_HOT = with_views("""
SELECT event_id, type, CAST(type = 'L' AS INTEGER) AS Type_L, CAST(type = 'M' AS INTEGER) AS Type_M FROM sensors""",
                         "sensors")


CLEAN_COLS = ["air_temp", "process_temp", "rotational_speed", "torque", "tool_wear", "machine_failure",
              "TWF", "HDF", "PWF", "OSF", "RNF", "Type_L", "Type_M"]


def q_clean_table(spark, d):
    return cleaning.clean(raw_frame(spark, d))


SQL_CLEAN = with_views(f"""
, raw AS ({RAW_SQL})
SELECT "Air temperature [K]" AS air_temp, "Process temperature [K]" AS process_temp,
       "Rotational speed [rpm]" AS rotational_speed, "Torque [Nm]" AS torque, "Tool wear [min]" AS tool_wear,
       "Machine failure" AS machine_failure, TWF, HDF, PWF, OSF, RNF,
       CAST("Type" = 'L' AS INTEGER) AS Type_L, CAST("Type" = 'M' AS INTEGER) AS Type_M FROM raw""", "flagged")


def q_exclude_features(spark, d):
    return cleaning.exclude_columns(cleaning.clean(raw_frame(spark, d)))


SQL_EXCLUDE = with_views(f"""
, raw AS ({RAW_SQL})
SELECT "Air temperature [K]" AS air_temp, "Process temperature [K]" AS process_temp,
       "Rotational speed [rpm]" AS rotational_speed, "Torque [Nm]" AS torque, "Tool wear [min]" AS tool_wear,
       CAST("Type" = 'L' AS INTEGER) AS Type_L, CAST("Type" = 'M' AS INTEGER) AS Type_M FROM raw""", "flagged")


def q_median_impute(spark, d):
    """P11 over all numeric columns."""
    return cleaning.median_impute(fx.with_nulls(spark, d)).select("event_id", *rules.SENSORS)


SQL_MEDIAN = with_views(f"""
, nulls AS ({NULLS_SQL})
SELECT event_id, coalesce(air_temp, (SELECT quantile_cont(air_temp, 0.5) FROM nulls)) AS air_temp,
       process_temp, rotational_speed, torque, tool_wear FROM nulls""", "sensors")


def q_coerce_types(spark, d):
    b = fx.bad_numbers(spark, d).select("event_id", "torque", F.col("tool_wear").cast("string").alias("tool_wear"))
    return cleaning.coerce_types(b, numeric=["torque"], integer=["tool_wear"])


SQL_COERCE = with_views("""
SELECT event_id, TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(torque AS VARCHAR) END AS DOUBLE) AS torque,
       CAST(trunc(TRY_CAST(CAST(tool_wear AS VARCHAR) AS DOUBLE)) AS INTEGER) AS tool_wear FROM sensors""", "sensors")


def q_dedup_rows(spark, d):
    return cleaning.dedup_rows(fx.raw_dirty(spark, d))


SQL_DEDUP = with_views("SELECT DISTINCT * FROM (SELECT * FROM sensors UNION ALL SELECT * FROM sensors "
                       "WHERE event_id % 10 = 0)", "sensors")


def q_dedup_report(spark, d):
    return cleaning.dedup_report(fx.raw_dirty(spark, d))


SQL_DEDUP_REPORT = with_views("""
, dirty AS (SELECT * FROM sensors UNION ALL SELECT * FROM sensors WHERE event_id % 10 = 0)
SELECT (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS rows_after,
       (SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS removed""", "sensors")


def q_align_features(spark, d):
    s = cleaning.one_hot(fx.sensors(spark, d), "type", prefix="Type")
    return scoring.align_features(s, ["event_id", *MODEL_FEATURES])


SQL_ALIGN = with_views("SELECT CAST(event_id AS DOUBLE) AS event_id, " + ", ".join(
    [f"CAST({c} AS DOUBLE) AS {c}" for c in rules.SENSORS]
    + ["CAST(CAST(type = 'L' AS INTEGER) AS DOUBLE) AS Type_L", "CAST(CAST(type = 'M' AS INTEGER) AS DOUBLE) AS Type_M"]
    + [f"0.0e0 AS {c}" for c in MODEL_FEATURES[7:]]) + " FROM sensors", "sensors")


def q_filter_by_risk(spark, d):
    return logs.of_risk(fx.predictions(spark, d), "CRITICAL").select("event_id", "machine_id", "ts", "failure_probability")


SQL_FILTER_RISK = with_views("""
SELECT event_id, machine_id, ts, failure_probability FROM predictions WHERE risk_level = 'CRITICAL'""", "predictions")


def q_filter_by_machine(spark, d):
    return logs.of_machine(fx.predictions(spark, d), 7).select("event_id", "machine_id", "ts", "prediction", "risk_level")


SQL_FILTER_MACHINE = with_views("""
SELECT event_id, machine_id, ts, prediction, risk_level FROM predictions WHERE machine_id = 7""", "predictions")


def q_log_at_risk_rows(spark, d):
    """P20: every predicted failure of the log with its readings (no resolved column in the log)."""
    return logs.failures_of_log(fx.predictions(spark, d))


SQL_LOG_AT_RISK = with_views(f"""
SELECT ts AS "timestamp", machine_id, risk_level, failure_probability AS avg_risk_score, {SENS}
FROM predictions WHERE prediction = 1""", "predictions")


QUERIES = {
    "schema_check": (q_schema_check, SQL_SCHEMA),
    "null_profile": (q_null_profile, _null_sql()),
    "target_profile": (q_target_profile, SQL_TARGET),
    "category_counts": (q_category_counts, SQL_CATEGORY),
    "numeric_describe": (q_numeric_describe, SQL_DESCRIBE),
    "column_value_counts": (q_column_value_counts, SQL_VALUE_COUNTS),
    "distinct_counts": (q_distinct_counts, SQL_DISTINCT),
    "one_hot": (q_one_hot, SQL_ONE_HOT),
    "clean_table": (q_clean_table, SQL_CLEAN),
    "exclude_features": (q_exclude_features, SQL_EXCLUDE),
    "median_impute": (q_median_impute, SQL_MEDIAN),
    "coerce_types": (q_coerce_types, SQL_COERCE),
    "dedup_rows": (q_dedup_rows, SQL_DEDUP),
    "dedup_report": (q_dedup_report, SQL_DEDUP_REPORT),
    "align_features": (q_align_features, SQL_ALIGN),
    "filter_by_risk": (q_filter_by_risk, SQL_FILTER_RISK),
    "filter_by_machine": (q_filter_by_machine, SQL_FILTER_MACHINE),
    "log_at_risk_rows": (q_log_at_risk_rows, SQL_LOG_AT_RISK),
}
