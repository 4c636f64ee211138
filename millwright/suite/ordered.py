"""Registered ordered / feature queries (W*, T*) with their DuckDB oracle text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators import features as feat
from ..operators import ordering
from .base_sql import with_views

KEYS = ["event_id", "machine_id", "ts"]
W_MACHINE = "PARTITION BY machine_id ORDER BY ts, event_id"


def _r6(df, cols):
    return df.select(*KEYS, *[F.round(c, 6).alias(c) for c in cols])


def q_rolling_mean(spark, d):
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {"air_temp": (("mean",), "air_temp"), "process_temp": (("mean",), "process_temp")})
    return _r6(out, ["air_temp_mean_6", "process_temp_mean_6"])


SQL_ROLLING_MEAN = with_views(f"""
SELECT event_id, machine_id, ts,
  round(avg(air_temp) OVER w, 6) AS air_temp_mean_6,
  round(avg(process_temp) OVER w, 6) AS process_temp_mean_6
FROM sensors WINDOW w AS ({W_MACHINE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "sensors")


def q_rolling_std(spark, d):
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {"rotational_speed": (("std",), "rpm"), "torque": (("std",), "torque")})
    return _r6(out, ["rpm_std_6", "torque_std_6"])


SQL_ROLLING_STD = with_views(f"""
SELECT event_id, machine_id, ts,
  round(stddev_samp(rotational_speed) OVER w, 6) AS rpm_std_6,
  round(stddev_samp(torque) OVER w, 6) AS torque_std_6
FROM sensors WINDOW w AS ({W_MACHINE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "sensors")


def q_rolling_min_max(spark, d):
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {"torque": (("min", "max"), "torque")})
    return _r6(out, ["torque_min_6", "torque_max_6"])


SQL_ROLLING_MIN_MAX = with_views(f"""
SELECT event_id, machine_id, ts,
  round(min(torque) OVER w, 6) AS torque_min_6, round(max(torque) OVER w, 6) AS torque_max_6
FROM sensors WINDOW w AS ({W_MACHINE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "sensors")


GRID = {"air_temp": (("mean", "std"), "air"), "torque": (("min", "max", "mean"), "tq")}


def q_rolling_grid(spark, d):
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {**GRID, "missing_col": (("mean",), "nope")}, windows=(3, 12))
    cols = [f"{p}_{st}_{w}" for w in (3, 12) for c, (sts, p) in GRID.items() for st in sts]
    return _r6(out, cols)


def _grid_sql():
    parts = []
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    for w in (3, 12):
        for c, (sts, p) in GRID.items():
            for st in sts:
                parts.append(f"round({fn[st]}({c}) OVER ({W_MACHINE} ROWS BETWEEN {w-1} PRECEDING AND CURRENT ROW), 6)"
                             f" AS {p}_{st}_{w}")
    return with_views("SELECT event_id, machine_id, ts, " + ", ".join(parts) + " FROM sensors", "sensors")


def q_rolling_strict(spark, d):
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {"air_temp": (("mean",), "air_temp"), "torque": (("std",), "torque")}, strict=True)
    return _r6(out, ["air_temp_mean_6", "torque_std_6"])


SQL_ROLLING_STRICT = with_views(f"""
SELECT event_id, machine_id, ts,
  CASE WHEN count(air_temp) OVER w = 6 THEN round(avg(air_temp) OVER w, 6) END AS air_temp_mean_6,
  CASE WHEN count(torque) OVER w = 6 THEN round(stddev_samp(torque) OVER w, 6) END AS torque_std_6
FROM sensors WINDOW w AS ({W_MACHINE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""", "sensors")


def q_lag_features(spark, d):
    out = feat.lags(fx.sensors(spark, d))
    return _r6(out, ["air_temp_lag1", "air_temp_lag2"])


SQL_LAG = with_views(f"""
SELECT event_id, machine_id, ts,
  round(lag(air_temp, 1) OVER ({W_MACHINE}), 6) AS air_temp_lag1,
  round(lag(air_temp, 2) OVER ({W_MACHINE}), 6) AS air_temp_lag2
FROM sensors""", "sensors")


def q_rolling_global(spark, d):
    """Whole-table (reference) form: no machine partition, chunked scan."""
    s = fx.sensors(spark, d)
    out = feat.rolling(s, {"air_temp": (("mean",), "air_temp"), "rotational_speed": (("std",), "rpm")},
                       partition_by=None)
    out = feat.lags(out, partition_by=None)
    return _r6(out, ["air_temp_mean_6", "rpm_std_6", "air_temp_lag1", "air_temp_lag2"])


SQL_ROLLING_GLOBAL = with_views("""
SELECT event_id, machine_id, ts,
  round(avg(air_temp) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS air_temp_mean_6,
  round(stddev_samp(rotational_speed) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6)
    AS rpm_std_6,
  round(lag(air_temp, 1) OVER (ORDER BY ts, event_id), 6) AS air_temp_lag1,
  round(lag(air_temp, 2) OVER (ORDER BY ts, event_id), 6) AS air_temp_lag2
FROM sensors""", "sensors")


def q_ewm_mean(spark, d):
    out = feat.ewm_mean(fx.sensors(spark, d))
    return _r6(out, ["rpm_ema"])


def _ewm_sql(partition: bool) -> str:
    q = 1.0 - 2.0 / 7.0
    part = "PARTITION BY machine_id " if partition else ""
    join = "a.machine_id = b.machine_id AND " if partition else ""
    return with_views(f"""
, numbered AS (SELECT *, row_number() OVER ({part}ORDER BY ts, event_id) AS rn FROM sensors)
SELECT a.event_id, a.machine_id, a.ts,
  round(sum(pow({q!r}, a.rn - b.rn) * b.rotational_speed) / sum(pow({q!r}, a.rn - b.rn)), 6) AS rpm_ema
FROM numbered a JOIN numbered b ON {join}b.rn <= a.rn
GROUP BY a.event_id, a.machine_id, a.ts""", "sensors")


def q_ewm_global(spark, d):
    out = feat.ewm_mean(fx.sensors(spark, d), partition_by=None)
    return _r6(out, ["rpm_ema"])


def q_ewm_long_span(spark, d):
    """W9 with span 1000 in whole-table order: exact carry between chunks."""
    out = feat.ewm_carried(fx.sensors(spark, d), "rotational_speed", 1000, "rpm_ema", partition_by=None)
    return out.select("event_id", "machine_id", F.round("rpm_ema", 6).alias("rpm_ema"))


SQL_EWM_LONG = with_views(f"""
, numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM sensors)
SELECT event_id, machine_id, round(sum(pow({1.0 - 2.0 / 1001.0!r}, -rn) * rotational_speed) OVER (ORDER BY rn)
                                   / sum(pow({1.0 - 2.0 / 1001.0!r}, -rn)) OVER (ORDER BY rn), 6) AS rpm_ema FROM numbered""", "sensors")


def q_derived_features(spark, d):
    out = feat.derived(fx.sensors(spark, d))
    return _r6(out, ["temp_diff", "wear_torque"])


SQL_DERIVED = with_views("""
SELECT event_id, machine_id, ts, round(process_temp - air_temp, 6) AS temp_diff,
       round(tool_wear * torque, 6) AS wear_torque FROM sensors""", "sensors")


def q_fill_features(spark, d):
    """W10 + W12 on the imputation fixture: back then forward fill per machine, drop leftovers."""
    s = fx.with_nulls(spark, d).select(*KEYS, F.col("air_temp").alias("air_temp_lag1"), "torque")
    out = feat.fill_nulls(s, ["air_temp_lag1"])
    return _r6(out, ["air_temp_lag1", "torque"])


SQL_FILL = with_views(f"""
, nulls AS (SELECT event_id, machine_id, ts,
     CASE WHEN event_id % 11 = 0 THEN NULL ELSE air_temp END AS air_temp_lag1, torque FROM sensors)
, back AS (SELECT event_id, machine_id, ts, torque,
     last_value(air_temp_lag1 IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM nulls)
, fwd AS (SELECT event_id, machine_id, ts, torque,
     last_value(v IGNORE NULLS) OVER ({W_MACHINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM back)
SELECT event_id, machine_id, ts, round(v, 6) AS air_temp_lag1, round(torque, 6) AS torque
FROM fwd WHERE v IS NOT NULL AND torque IS NOT NULL""", "sensors")


def q_fill_global(spark, d):
    """Whole-table back/forward fill through the chunk carries."""
    s = fx.with_nulls(spark, d).select(*KEYS, "air_temp")
    out = feat.fill_nulls(s, ["air_temp"], partition_by=None, drop_remaining=False)
    return _r6(out, ["air_temp"])


SQL_FILL_GLOBAL = with_views("""
, nulls AS (SELECT event_id, machine_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE air_temp END AS air_temp
            FROM sensors)
, back AS (SELECT event_id, machine_id, ts, last_value(air_temp IGNORE NULLS) OVER (ORDER BY ts DESC, event_id DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM nulls)
SELECT event_id, machine_id, ts, round(last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS air_temp FROM back""", "sensors")


def q_ffill_all(spark, d):
    out = feat.forward_fill_all(fx.with_nulls(spark, d).select(*KEYS, *rules.SENSORS))
    return _r6(out, rules.SENSORS)


SQL_FFILL_ALL = with_views(f"""
, nulls AS (SELECT event_id, machine_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE air_temp END AS air_temp,
            process_temp, rotational_speed, torque, tool_wear FROM sensors)
SELECT event_id, machine_id, ts,
  round(last_value(air_temp IGNORE NULLS) OVER ({W_MACHINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6)
    AS air_temp, round(process_temp, 6) AS process_temp, round(rotational_speed, 6) AS rotational_speed,
  round(torque, 6) AS torque, round(tool_wear, 6) AS tool_wear
FROM nulls""", "sensors")


FEATURE_COLS = ["air_temp_mean_6", "process_temp_mean_6", "rpm_std_6", "torque_std_6", "air_temp_lag1",
                "air_temp_lag2", "temp_diff", "wear_torque", "rpm_ema"]


def q_feature_table(spark, d):
    out = feat.feature_pipeline(fx.sensors(spark, d))
    return _r6(out, FEATURE_COLS)


def _feature_sql():
    q = 1.0 - 2.0 / 7.0
    fill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" if c not in ("temp_diff", "wear_torque", "rpm_ema")
        else c for c in FEATURE_COLS)
    ffill = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({W_MACHINE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}"
        if c not in ("temp_diff", "wear_torque", "rpm_ema") else c for c in FEATURE_COLS)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in FEATURE_COLS)
    r = ", ".join(f"round({c}, 6) AS {c}" for c in FEATURE_COLS)
    return with_views(f"""
, numbered AS (SELECT *, row_number() OVER ({W_MACHINE}) AS rn FROM sensors)
, ewm AS (SELECT a.event_id, sum(pow({q!r}, a.rn - b.rn) * b.rotational_speed) / sum(pow({q!r}, a.rn - b.rn)) AS rpm_ema
          FROM numbered a JOIN numbered b ON a.machine_id = b.machine_id AND b.rn <= a.rn
          GROUP BY a.event_id)
, raw AS (SELECT event_id, machine_id, ts,
    avg(air_temp) OVER w AS air_temp_mean_6, avg(process_temp) OVER w AS process_temp_mean_6,
    stddev_samp(rotational_speed) OVER w AS rpm_std_6, stddev_samp(torque) OVER w AS torque_std_6,
    lag(air_temp, 1) OVER ({W_MACHINE}) AS air_temp_lag1, lag(air_temp, 2) OVER ({W_MACHINE}) AS air_temp_lag2,
    process_temp - air_temp AS temp_diff, tool_wear * torque AS wear_torque, rpm_ema
  FROM sensors JOIN ewm USING (event_id)
  WINDOW w AS ({W_MACHINE} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
, back AS (SELECT event_id, machine_id, ts, {fill} FROM raw)
, fwd AS (SELECT event_id, machine_id, ts, {ffill} FROM back)
SELECT event_id, machine_id, ts, {r} FROM fwd WHERE {nn}""", "sensors")


def q_retain_last_n(spark, d):
    s = fx.sensors(spark, d).select(*KEYS, "torque")
    return feat.retain_last_n(s, 20)


SQL_RETAIN = with_views("""
SELECT event_id, machine_id, ts, torque FROM sensors
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) <= 20""", "sensors")


def q_row_position(spark, d):
    s = fx.sensors(spark, d).select(*KEYS)
    out = ordering.row_position(s, ["ts", "event_id"], name="row_position")
    out = ordering.row_position(out, ["ts", "event_id"], ["machine_id"], name="machine_position",
                                size_name="machine_rows")
    return out


SQL_ROW_POSITION = with_views("""
SELECT event_id, machine_id, ts,
  CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS row_position,
  CAST(row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) - 1 AS BIGINT) AS machine_position,
  CAST(count(*) OVER (PARTITION BY machine_id) AS BIGINT) AS machine_rows
FROM sensors""", "sensors")


QUERIES = {
    "rolling_mean": (q_rolling_mean, SQL_ROLLING_MEAN),
    "rolling_std": (q_rolling_std, SQL_ROLLING_STD),
    "rolling_min_max": (q_rolling_min_max, SQL_ROLLING_MIN_MAX),
    "rolling_grid": (q_rolling_grid, _grid_sql()),
    "rolling_strict": (q_rolling_strict, SQL_ROLLING_STRICT),
    "rolling_global": (q_rolling_global, SQL_ROLLING_GLOBAL),
    "lag_features": (q_lag_features, SQL_LAG),
    "ewm_mean": (q_ewm_mean, _ewm_sql(True)),
    "ewm_global": (q_ewm_global, _ewm_sql(False)),
    "ewm_long_span": (q_ewm_long_span, SQL_EWM_LONG),
    "derived_features": (q_derived_features, SQL_DERIVED),
    "fill_features": (q_fill_features, SQL_FILL),
    "fill_global": (q_fill_global, SQL_FILL_GLOBAL),
    "ffill_all": (q_ffill_all, SQL_FFILL_ALL),
    "feature_table": (q_feature_table, _feature_sql()),
    "retain_last_n": (q_retain_last_n, SQL_RETAIN),
    "row_position": (q_row_position, SQL_ROW_POSITION),
}
