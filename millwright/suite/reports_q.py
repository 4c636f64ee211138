"""Registered report / top-k / split queries (A*, T*, W17, W18, P10, P16, P17, F*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators import attribution, logs, ordering, reports
from ..plans.scoring import CHOSEN_MODEL, LINEAR_MODELS
from .base_sql import with_views

ORDER = ["ts", "event_id"]


def _band_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.8e0 THEN 'CRITICAL' WHEN {p} >= 0.5e0 THEN 'HIGH' "
            f"WHEN {p} >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END")


def _action_sql(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in rules.ACTIONS.items())
    return f"CASE {whens} ELSE '{rules.DEFAULT_ACTION}' END"


def _colour_sql(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{k}' THEN '{v}'" for k, v in rules.LEVEL_COLOURS.items())
    return f"CASE {whens} ELSE 'info' END"


def _parts_sql(m: str) -> str:
    whens = []
    for i, (lo, _) in enumerate(rules.PARTS_TIERS):
        parts = [p for _, ps in rules.PARTS_TIERS[i:] for p in ps]
        whens.append(f"WHEN {m} >= {lo}e0 THEN '{', '.join(parts)}'")
    return f"CASE {' '.join(whens)} ELSE '{', '.join(rules.DEFAULT_PARTS)}' END"


def _urg_sql(field: int, urg: str = "urgency") -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {urg} = '{k}' THEN {lit(v[field])}" for k, v in rules.URGENCY.items())
    return f"CASE {whens} END"


# --- A2 -----------------------------------------------------------------------------------------
def q_machines_at_risk_scored(spark, d):
    return reports.machines_at_risk(fx.predictions(spark, d), threshold=0.3)


SQL_AT_RISK = with_views(f"""
SELECT machine_id, risk_level, round(a, 4) AS average_risk_score, round(m, 4) AS max_risk_score, recent_readings,
  round(la, 2) AS last_air_temp, round(lp, 2) AS last_process_temp, round(lr, 2) AS last_rotational_speed,
  round(lt, 2) AS last_torque, round(lw, 2) AS last_tool_wear,
  {_colour_sql('risk_level')} AS risk_color, {_action_sql('risk_level')} AS recommended_action
FROM (SELECT *, CASE WHEN m >= 0.8e0 THEN 'CRITICAL' WHEN m >= 0.5e0 THEN 'HIGH' WHEN a >= 0.3e0 THEN 'MEDIUM'
                     ELSE 'LOW' END AS risk_level
      FROM (SELECT machine_id, avg(failure_probability) a, max(failure_probability) m, count(*) AS recent_readings,
                   max_by(air_temp, ts) la, max_by(process_temp, ts) lp, max_by(rotational_speed, ts) lr,
                   max_by(torque, ts) lt, max_by(tool_wear, ts) lw
            FROM predictions GROUP BY machine_id) g
      WHERE a >= 0.3e0) t
""", "predictions")


# --- A1 -----------------------------------------------------------------------------------------
def q_factory_health(spark, d):
    return reports.factory_health(fx.predictions(spark, d))


def _health_sql(source: str) -> str:
    score = "greatest(0.0e0, least(100.0e0, 100.0e0 - (rate * 0.5e0 + risk * 50.0e0)))"
    bands = " ".join(f"WHEN {score} >= {lo} THEN '{name}'" for lo, name, _ in rules.HEALTH_BANDS)
    colours = " ".join(f"WHEN {score} >= {lo} THEN '{c}'" for lo, _, c in rules.HEALTH_BANDS)
    return f"""
, numbered AS (SELECT prediction, failure_probability,
                      row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM {source})
, agg AS (SELECT count(*) AS total, CAST(coalesce(sum(prediction), 0) AS BIGINT) AS failures,
                 coalesce(avg(failure_probability), 0.0e0) AS risk,
                 coalesce(sum(CASE WHEN pos < n // 2 THEN prediction END), 0) AS h1,
                 coalesce(sum(CASE WHEN pos >= n // 2 THEN prediction END), 0) AS h2 FROM numbered)
, r AS (SELECT *, CASE WHEN total > 0 THEN failures / total * 100 ELSE 0.0e0 END AS rate FROM agg)
SELECT round({score}, 2) AS health_score, CASE {bands} ELSE 'CRITICAL' END AS status,
       CASE {colours} ELSE 'danger' END AS color,
       round(CASE WHEN total > 0 THEN (total - failures) / total * 100 ELSE 0.0e0 END, 2) AS uptime_percentage,
       round(rate, 2) AS failure_rate, round(risk, 4) AS average_risk, total AS total_samples_analyzed,
       failures AS failures_detected, total - failures AS normal_samples,
       CASE WHEN h2 < h1 THEN 'improving' ELSE 'declining' END AS trend
FROM r"""


SQL_HEALTH = with_views(_health_sql("predictions"), "predictions")


def q_factory_health_recent(spark, d):
    """A1 exactly as the reference scopes it: the last 1000 readings (a recent-window report)."""
    return reports.factory_health(fx.predictions(spark, d), last_n=1000)


SQL_HEALTH_RECENT = with_views(
    "\n, recent AS (SELECT * FROM predictions ORDER BY ts DESC, event_id DESC LIMIT 1000)" + _health_sql("recent"),
    "predictions")


# --- A3 -----------------------------------------------------------------------------------------
def q_maintenance_schedule(spark, d):
    out = reports.maintenance_schedule(fx.predictions(spark, d))
    return out.withColumn("parts_required", F.array_join("parts_required", ", "))


SQL_SCHEDULE = with_views(f"""
, g AS (SELECT machine_id, avg(failure_probability) a, max(failure_probability) m FROM predictions GROUP BY machine_id)
, u AS (SELECT *, CASE WHEN m >= 0.8e0 THEN 'IMMEDIATE' WHEN m >= 0.6e0 THEN 'URGENT' WHEN a >= 0.4e0 THEN 'SOON'
                       ELSE 'ROUTINE' END AS urgency, (SELECT max(ts) FROM predictions) AS base FROM g)
, s AS (SELECT *, base + to_days({_urg_sql(0)}) AS sched, {_urg_sql(2)} AS hours FROM u)
SELECT machine_id, {_urg_sql(3)} AS maintenance_type, urgency, {_urg_sql(1)} AS priority,
       strftime(sched, '%Y-%m-%d') AS scheduled_date, strftime(sched, '%H:%M') AS scheduled_time,
       hours AS estimated_duration_hours, round(a, 4) AS risk_score, round(m, 4) AS max_risk_score,
       printf('Machine %d requires %s. Current risk: %.1f%%', machine_id, lower({_urg_sql(3)}), round(a * 100, 1))
         AS description,
       'Scheduled' AS status, strftime(sched + to_hours(hours), '%Y-%m-%d %H:%M') AS estimated_completion,
       {_parts_sql('m')} AS parts_required, floor((hours * 150 + m * 500) * 100 + 0.5e0) / 100 AS estimated_cost
FROM s""", "predictions")


# --- A4 -----------------------------------------------------------------------------------------
def q_fleet_diagnostics(spark, d):
    total = fx.registry(spark, d).agg(F.count(F.lit(1)).alias("total_machines"))
    return reports.fleet_diagnostics(fx.predictions(spark, d), total_machines=total)


SQL_DIAG = with_views("""
, a AS (SELECT count(DISTINCT machine_id) AS m,
          count_if(failure_probability >= 0.8e0) AS critical,
          count_if(failure_probability >= 0.5e0 AND failure_probability < 0.8e0) AS high,
          count_if(failure_probability >= 0.3e0 AND failure_probability < 0.5e0) AS medium,
          count_if(failure_probability < 0.3e0) AS low,
          round(avg(air_temp), 2) AS avg_air_temperature, round(avg(rotational_speed), 2) AS avg_rotational_speed,
          round(avg(torque), 2) AS avg_torque, count(*) AS data_points_analyzed,
          round(avg(greatest(failure_probability, 1.0e0 - failure_probability)), 4) AS model_confidence
        FROM predictions)
, t AS (SELECT count(*) AS total_machines FROM registry)
SELECT total_machines, m AS machines_monitored, m AS machines_online, total_machines - m AS machines_offline,
       round(m / total_machines * 100, 2) AS monitoring_uptime, critical, high, medium, low, avg_air_temperature,
       avg_rotational_speed, avg_torque, data_points_analyzed, model_confidence
FROM a, t""", "predictions", "registry")


# --- A5 -----------------------------------------------------------------------------------------
def q_dashboard_summary(spark, d):
    """A5: the four dashboard aggregates from one scored frame, as one row."""
    scored = fx.predictions(spark, d)
    h = reports.factory_health(scored).select("health_score", "status", "trend")
    r = reports.machines_at_risk(scored).agg(F.count(F.lit(1)).alias("machines_at_risk"))
    m = reports.maintenance_schedule(scored).agg(
        F.count_if(F.col("urgency") == "IMMEDIATE").alias("immediate_tasks"),
        F.count(F.lit(1)).alias("scheduled_tasks"))
    g = reports.fleet_diagnostics(scored).select("machines_monitored", "model_confidence")
    return h.crossJoin(r).crossJoin(m).crossJoin(g)


def _strip_with(sql: str) -> str:
    """Body of a with_views() query (after the shared CTEs)."""
    marker = "\n)\n"
    last = sql.rfind(marker)
    return sql[last + len(marker):]


def _dashboard_sql_final():
    at_risk_body = _strip_with(SQL_AT_RISK)
    sched_body = _strip_with(SQL_SCHEDULE)
    # schedule body starts with its own CTE list (", g AS ..."): turn it into a nested WITH
    sched_nested = "WITH " + sched_body.lstrip().lstrip(",")
    body = _health_sql("predictions")
    sel_at = body.rfind("\nSELECT round(")
    health_select = body[sel_at:]
    ctes = body[:sel_at]
    return with_views(f"""{ctes}
, h AS ({health_select.strip()})
SELECT h.health_score, h.status, h.trend, r.machines_at_risk, m.immediate_tasks, m.scheduled_tasks,
       g.machines_monitored, g.model_confidence
FROM h,
 (SELECT count(*) AS machines_at_risk FROM ({at_risk_body.strip()}) x) r,
 (SELECT count_if(urgency = 'IMMEDIATE') AS immediate_tasks, count(*) AS scheduled_tasks FROM ({sched_nested}) y) m,
 (SELECT count(DISTINCT machine_id) AS machines_monitored,
         round(avg(greatest(failure_probability, 1.0e0 - failure_probability)), 4) AS model_confidence
  FROM predictions) g""", "predictions")


def q_dashboard_reports(spark, d):
    """A5 in full: the four reports from one table of parts, one below the other."""
    total = fx.registry(spark, d).agg(F.count(F.lit(1)).alias("total_machines"))
    found = reports.dashboard(fx.predictions(spark, d), total)
    found["schedule"] = found["schedule"].withColumn("parts_required", F.array_join("parts_required", ", "))
    rows = [df.withColumn("report", F.lit(name)) for name, df in found.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def _dashboard_reports_sql():
    def nested(sql):
        body = _strip_with(sql).strip()
        return "WITH " + body.lstrip(",") if body.startswith(",") else body
    bodies = {"health": _health_sql("predictions").strip(), "at_risk": SQL_AT_RISK, "schedule": SQL_SCHEDULE, "diagnostics": SQL_DIAG}
    texts = {k: "WITH " + v.lstrip(",") if k == "health" else nested(v) for k, v in bodies.items()}
    return with_views("\nUNION ALL BY NAME\n".join(f"SELECT '{k}' AS report, * FROM ({v})" for k, v in texts.items()),
                      "predictions", "registry")


# --- A6, A7, A8 ---------------------------------------------------------------------------------
def q_prediction_stats(spark, d):
    return reports.prediction_stats(fx.predictions(spark, d))


SQL_PSTATS = with_views("""
SELECT count(*) AS total_predictions, count_if(risk_level = 'CRITICAL') AS critical,
       count_if(risk_level = 'HIGH') AS high, count_if(risk_level = 'MEDIUM') AS medium,
       count_if(risk_level = 'LOW') AS low, round(avg(failure_probability), 4) AS average_probability,
       round(max(failure_probability), 4) AS max_probability FROM predictions""", "predictions")


def q_hourly_distribution(spark, d):
    return reports.hourly_distribution(fx.predictions(spark, d))


SQL_HOURLY = with_views("""
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS predictions FROM predictions GROUP BY 1""", "predictions")


def q_machines_summary(spark, d):
    return reports.machines_summary(fx.predictions(spark, d))


SQL_MSUMMARY = with_views("""
SELECT machine_id, count(*) AS total_predictions, count_if(prediction = 1) AS failures,
       count_if(risk_level = 'CRITICAL') AS critical_risk, round(avg(failure_probability), 4) AS avg_failure_prob,
       max(ts) AS last_prediction FROM predictions GROUP BY machine_id""", "predictions")


# --- A9 -----------------------------------------------------------------------------------------
def q_machine_stats(spark, d):
    return reports.machine_stats(fx.predictions(spark, d))


SQL_MSTATS = with_views("""
, n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS ra,
               row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS rd FROM predictions)
SELECT machine_id, count(*) AS total_predictions, round(avg(failure_probability), 4) AS average_failure_probability,
       floor(max(failure_probability) * 10000.0e0 + 0.5e0) / 10000.0e0 AS max_failure_probability,
       floor(min(failure_probability) * 10000.0e0 + 0.5e0) / 10000.0e0 AS min_failure_probability,
       round(stddev_pop(failure_probability), 4) AS std_failure_probability,
       count_if(risk_level = 'CRITICAL') AS critical, count_if(risk_level = 'HIGH') AS high,
       count_if(risk_level = 'MEDIUM') AS medium, count_if(risk_level = 'LOW') AS low,
       max(ts) AS latest_timestamp, max_by(failure_probability, ts) AS latest_probability,
       max_by(risk_level, ts) AS latest_risk_level,
       CASE WHEN avg(CASE WHEN rd <= 50 THEN failure_probability END)
               < avg(CASE WHEN ra <= 50 THEN failure_probability END) THEN 'improving' ELSE 'declining' END AS trend
FROM n GROUP BY machine_id""", "predictions")


# --- A10 ----------------------------------------------------------------------------------------
def _machines(spark, d):
    s = fx.sensors(spark, d)
    per = s.groupBy("machine_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                                      F.sum("machine_failure").cast("long").alias("total_failures"))
    reg = fx.registry(spark, d).select("machine_id", "status")
    return reg.join(per, "machine_id").select(
        "machine_id", "status", "total_failures",
        (F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("last_seen")) / F.lit(3600e6))
        .alias("total_operating_hours"))


def q_fleet_overview(spark, d):
    return reports.fleet_overview(_machines(spark, d))


SQL_FLEET = with_views("""
, m AS (SELECT r.machine_id, r.status, p.total_failures, p.hours AS total_operating_hours
        FROM registry r JOIN (SELECT machine_id, CAST(sum(machine_failure) AS BIGINT) AS total_failures,
                                     date_diff('microsecond', min(ts), max(ts)) / 3600e6 AS hours
                              FROM sensors GROUP BY machine_id) p ON r.machine_id = p.machine_id)
, t AS (SELECT count(*) AS total_machines, round(sum(total_operating_hours), 2) AS total_operating_hours,
               CAST(sum(total_failures) AS BIGINT) AS total_failures_recorded,
               round(sum(total_failures) / count(*), 2) AS average_failures_per_machine FROM m)
SELECT s.status, s.machines, t.* FROM (SELECT status, count(*) AS machines FROM m GROUP BY status) s, t""",
                       "sensors", "registry")


# --- A11 ----------------------------------------------------------------------------------------
def q_model_confidence(spark, d):
    return reports.model_confidence(fx.predictions(spark, d))


SQL_CONF = with_views("""
, n AS (SELECT 1.0e0 - failure_probability AS c, ensemble_agreement,
               row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM predictions)
, a AS (SELECT count(*) AS total_predictions, avg(c) AS av, avg(ensemble_agreement) AS ag,
               avg(CASE WHEN pos < total // 2 THEN c END) AS h1, avg(CASE WHEN pos >= total // 2 THEN c END) AS h2,
               count_if(c >= 0.8e0) AS high, count_if(c >= 0.6e0 AND c < 0.8e0) AS medium,
               count_if(c < 0.6e0) AS low FROM n)
SELECT round(coalesce(av, 0.85e0), 4) AS average_confidence, round(coalesce(ag, 0.92e0), 4) AS ensemble_agreement,
       total_predictions,
       CASE WHEN total_predictions > 10 THEN CASE WHEN h2 > h1 THEN 'improving' ELSE 'declining' END
            ELSE 'stable' END AS confidence_trend, high, medium, low FROM a""", "predictions")


# --- A12, A18 -----------------------------------------------------------------------------------
def q_sensor_anomalies(spark, d):
    return reports.sensor_anomalies(fx.sensors(spark, d))


def _anomaly_sql():
    sens = rules.SENSORS
    stats = ", ".join(f"avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}" for s in sens)
    counts = ", ".join(f"count_if({s} > m_{s} + 3.0e0 * s_{s} OR {s} < m_{s} - 3.0e0 * s_{s}) AS c_{s}" for s in sens)
    unions = " UNION ALL ".join(
        f"SELECT '{s}' AS sensor, c_{s} AS anomaly_count, n, m_{s} AS mu, s_{s} AS sd FROM c, st" for s in sens)
    return f"""
, st AS (SELECT {stats} FROM sensors)
, c AS (SELECT count(*) AS n, {counts} FROM sensors, st)
, l AS ({unions})
SELECT sensor, anomaly_count, n AS total_readings, round(anomaly_count / n * 100, 2) AS anomaly_percentage,
       round(mu + 3.0e0 * sd, 2) AS threshold_high, round(mu - 3.0e0 * sd, 2) AS threshold_low,
       round(mu, 2) AS current_mean, round(sd, 2) AS current_std
FROM l WHERE anomaly_count > 0"""


SQL_ANOM = with_views(_anomaly_sql(), "sensors")


def q_anomaly_overview(spark, d):
    return reports.anomaly_overview(reports.sensor_anomalies(fx.sensors(spark, d)))


SQL_ANOM_OVERVIEW = with_views(_anomaly_sql().replace("\nSELECT sensor,", "\n, an AS (SELECT sensor,", 1)
                               + """)
, o AS (SELECT count(*) AS k, CAST(coalesce(sum(anomaly_count), 0) AS BIGINT) AS total, max(total_readings) AS n
        FROM an)
, r AS (SELECT *, round(CASE WHEN k > 0 THEN total / (k * n) * 100 ELSE 0.0e0 END, 2) AS rate FROM o)
SELECT 5 AS sensors_monitored, k AS sensors_with_anomalies, total AS total_anomalies, rate AS avg_anomaly_rate,
       CASE WHEN rate > 5 THEN 'Critical' WHEN rate > 2 THEN 'Warning' ELSE 'Normal' END AS status FROM r""",
                               "sensors")


# --- A13, W17, W18, P19 -------------------------------------------------------------------------
SENS = ", ".join(rules.SENSORS)


def q_unresolved_failures(spark, d):
    """Unresolved predicted failures, all of them; a page size belongs to the caller."""
    return logs.unresolved_failures(fx.machine_failures(spark, d)).select(
        "id", "timestamp", "machine_id", "failure_probability", "risk_level", *rules.SENSORS)


SQL_UNRESOLVED = with_views(f"""
SELECT id, "timestamp", machine_id, failure_probability, risk_level, {SENS} FROM machine_failures
WHERE resolved = 0 AND prediction = 1""", "machine_failures")


def q_newest_failure_per_machine(spark, d):
    return logs.newest_failure_per_machine(fx.machine_failures(spark, d))


SQL_NEWEST = with_views(f"""
SELECT machine_id, id, "timestamp", risk_level, failure_probability, {SENS} FROM machine_failures
WHERE resolved = 0 AND prediction = 1
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, id DESC) = 1""", "machine_failures")


def q_oldest_failure_per_machine(spark, d):
    """First failure per machine in log order (ascending; first wins)."""
    return logs.oldest_failure_per_machine(fx.predictions(spark, d))


SQL_OLDEST = with_views(f"""
SELECT machine_id, ts, event_id, risk_level, failure_probability, {SENS} FROM predictions WHERE prediction = 1
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) = 1""", "predictions")


def q_at_risk_report(spark, d):
    """Newest unresolved failure per machine with readings and top-3 reasons, highest probability first."""
    reasons = attribution.linear_top_k(fx.sensors(spark, d), LINEAR_MODELS[CHOSEN_MODEL]).withColumnRenamed("event_id", "id")
    n = reports.at_risk_report(fx.machine_failures(spark, d), reasons)
    return n.select("id", "timestamp", "machine_id", "risk_level", "rank",
                    *[f"{c}_{i}" for i in (1, 2, 3) for c in ("feature", "impact")],
                    F.col("failure_probability").alias("avg_risk_score"),
                    F.col("failure_probability").alias("max_risk_score"), *rules.SENSORS)


def _at_risk_report_sql():
    # Weights of the chosen scorer, written out here on purpose.
    weights = {"torque": "0.06e0", "tool_wear": "0.012e0", "air_temp": "0.10e0", "process_temp": "0.0e0", "rotational_speed": "0.0e0"}
    means = ", ".join(f"avg({n}) AS mu_{n}" for n in weights)
    parts = " UNION ALL ".join(f"SELECT event_id, '{n}' AS feature, {w} * ({n} - mu_{n}) AS phi FROM sensors, mu" for n, w in weights.items())
    wide = ", ".join(f"max(CASE WHEN i = {i} THEN feature END) AS feature_{i}, max(CASE WHEN i = {i} THEN round(phi, 4) END) AS impact_{i}"
                     for i in (1, 2, 3))
    return with_views(f"""
, mu AS (SELECT {means} FROM sensors)
, phi AS ({parts})
, placed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) AS i FROM phi)
, wide AS (SELECT event_id, {wide} FROM placed GROUP BY event_id)
, newest AS (SELECT * FROM machine_failures WHERE resolved = 0 AND prediction = 1
             QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY "timestamp" DESC, id DESC) = 1)
SELECT n.id, n."timestamp", n.machine_id, n.risk_level, row_number() OVER (ORDER BY failure_probability DESC, machine_id) AS rank,
       feature_1, impact_1, feature_2, impact_2, feature_3, impact_3, failure_probability AS avg_risk_score,
       failure_probability AS max_risk_score, {SENS} FROM newest n JOIN wide w ON w.event_id = n.id""", "sensors", "machine_failures")


SQL_AT_RISK_REPORT = _at_risk_report_sql()


# --- A15, A16, A17, A19, A20 --------------------------------------------------------------------
def q_failure_distribution(spark, d):
    return reports.failure_distribution(fx.sensors_with_flags(spark, d))


SQL_FAILDIST = with_views("""
SELECT CAST(coalesce(sum(machine_failure), 0) AS BIGINT) AS total_failures,
       count_if(machine_failure = 0) AS total_normal,
       CAST(sum(TWF) AS BIGINT) AS TWF, CAST(sum(HDF) AS BIGINT) AS HDF, CAST(sum(PWF) AS BIGINT) AS PWF,
       CAST(sum(OSF) AS BIGINT) AS OSF, CAST(sum(RNF) AS BIGINT) AS RNF FROM flagged""", "flagged")


def q_risk_distribution(spark, d):
    return reports.risk_distribution(fx.predictions(spark, d))


SQL_RISKDIST = with_views("""
SELECT l.risk_level, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) l(risk_level)
LEFT JOIN (SELECT risk_level, count(*) AS n FROM predictions GROUP BY risk_level) c ON l.risk_level = c.risk_level""",
                          "predictions")


def q_urgency_counts(spark, d):
    scored = fx.predictions(spark, d)
    return reports.urgency_counts(reports.machines_at_risk(scored), reports.maintenance_schedule(scored))


def _urgency_counts_sql():
    at_body = _strip_with(SQL_AT_RISK).strip()
    sched_nested = "WITH " + _strip_with(SQL_SCHEDULE).lstrip().lstrip(",")
    return with_views(f"""
SELECT 'risk_level' AS kind, risk_level AS label, count(*) AS count FROM ({at_body}) a GROUP BY risk_level
UNION ALL
SELECT 'urgency' AS kind, urgency AS label, count(*) AS count FROM ({sched_nested}) b GROUP BY urgency""",
                      "predictions")


def q_pos_weight(spark, d):
    return reports.pos_weight(fx.sensors(spark, d))


SQL_POSW = with_views("""
SELECT count_if(machine_failure = 1) AS positives, count_if(machine_failure = 0) AS negatives,
       count_if(machine_failure = 0) / greatest(count_if(machine_failure = 1), 1) AS scale_pos_weight
FROM sensors""", "sensors")


def q_telemetry_tail(spark, d):
    return reports.telemetry_tail(fx.sensors(spark, d), 200)


SQL_TELE = with_views(f"""
SELECT ts, event_id, {SENS} FROM sensors ORDER BY ts DESC, event_id DESC LIMIT 200""", "sensors")


# --- T1, T2, T6, T7, T9, P10, P16, P17 ----------------------------------------------------------
def q_tail_n(spark, d):
    return ordering.tail_n(fx.predictions(spark, d).select("event_id", "machine_id", "ts", "failure_probability"),
                           100, ORDER)


SQL_TAIL = with_views("""
SELECT event_id, machine_id, ts, failure_probability FROM predictions ORDER BY ts DESC, event_id DESC LIMIT 100""",
                      "predictions")


def q_head_n(spark, d):
    return ordering.head_n(fx.predictions(spark, d).select("event_id", "machine_id", "ts", "failure_probability"),
                           50, [F.col("failure_probability").desc(), F.col("event_id")])


SQL_HEAD = with_views("""
SELECT event_id, machine_id, ts, failure_probability FROM predictions ORDER BY failure_probability DESC, event_id
LIMIT 50""", "predictions")


def q_sort_by_time(spark, d):
    return fx.sensors(spark, d).select("event_id", "machine_id", "ts").orderBy("ts", "event_id")


SQL_SORT = with_views("SELECT event_id, machine_id, ts FROM sensors ORDER BY ts, event_id", "sensors")


def q_time_split(spark, d):
    return ordering.time_split(fx.sensors(spark, d).select("event_id", "ts"), ORDER, 0.2)


SQL_SPLIT = with_views("""
SELECT event_id, ts, CASE WHEN pos < CAST(floor(n * 0.8e0) AS BIGINT) THEN 'train' ELSE 'test' END AS split,
       pos AS row_position
FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM sensors)""",
                       "sensors")


def q_sample_per_class(spark, d):
    """First normal and first failing row of the test part."""
    return logs.sample_per_class(fx.sensors(spark, d), ["event_id", "ts", *rules.SENSORS])


SQL_SAMPLE = with_views(f"""
, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM sensors)
SELECT machine_failure, event_id, ts, {SENS} FROM n WHERE pos >= CAST(floor(total * 0.8e0) AS BIGINT)
QUALIFY row_number() OVER (PARTITION BY machine_failure ORDER BY pos) = 1""", "sensors")


def q_synthetic_ts(spark, d):
    """P10: 1-minute timestamps from 2024-01-01 by row position."""
    return logs.with_synthetic_time(fx.sensors(spark, d).select("event_id", "ts"), ORDER).select("event_id", "timestamp")


SQL_SYNTH = with_views("""
SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(row_number() OVER (ORDER BY ts, event_id) - 1
       AS BIGINT)) AS "timestamp" FROM sensors""", "sensors")


def q_assign_fleet(spark, d):
    """P16 + P17 over a table without machine ids (orders): machine = pos mod 50 + 1, row id."""
    return logs.with_machines(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), ["o_orderkey"])


SQL_FLEET_ASSIGN = """
SELECT o_orderkey, o_custkey, pos % 50 + 1 AS machine_id, printf('MACHINE_%04d', pos + 1) AS row_id
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"""


# --- F* scalar rules ----------------------------------------------------------------------------
def q_risk_band(spark, d):
    p = fx.predictions(spark, d)
    return p.select("event_id", "failure_probability", rules.risk_band("failure_probability").alias("risk_level"),
                    rules.level_colour(rules.risk_band("failure_probability")).alias("risk_color"))


SQL_BAND = with_views(f"""
SELECT event_id, failure_probability, {_band_sql('failure_probability')} AS risk_level,
       {_colour_sql(_band_sql('failure_probability'))} AS risk_color FROM predictions""", "predictions")


def q_action_lookup(spark, d):
    p = fx.predictions(spark, d)
    lv = F.when(F.col("event_id") % 17 == 0, F.lit("UNKNOWN")).otherwise(F.col("risk_level"))
    return p.select("event_id", lv.alias("level"), rules.action_for_level(lv).alias("recommended_action"))


SQL_ACTION = with_views(f"""
SELECT event_id, level, {_action_sql('level')} AS recommended_action
FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'UNKNOWN' ELSE risk_level END AS level FROM predictions)""",
                        "predictions")


def q_parts_list(spark, d):
    p = fx.predictions(spark, d)
    return p.select("event_id", "failure_probability",
                    F.array_join(rules.parts_list("failure_probability"), ", ").alias("parts_required"))


SQL_PARTS = with_views(f"""
SELECT event_id, failure_probability, {_parts_sql('failure_probability')} AS parts_required FROM predictions""",
                       "predictions")


def q_ensemble_agreement(spark, d):
    p = fx.predictions(spark, d)
    return p.select("event_id", "vote_m2", "vote_m1", "vote_m3", "vote_m4", "ensemble_agreement",
                    rules.agreement_label("ensemble_agreement").alias("agreement_label"))


SQL_AGREE = with_views("""
SELECT event_id, vote_m2, vote_m1, vote_m3, vote_m4, ensemble_agreement,
       CASE WHEN ensemble_agreement > 0.8e0 THEN 'Strong' WHEN ensemble_agreement > 0.6e0 THEN 'Good' ELSE 'Weak' END
         AS agreement_label FROM predictions""", "predictions")


def q_agreement_label(spark, d):
    p = fx.predictions(spark, d)
    return (p.groupBy(rules.agreement_label("ensemble_agreement").alias("agreement_label"))
            .agg(F.count(F.lit(1)).alias("predictions")))


SQL_AGREE_LABEL = with_views("""
SELECT CASE WHEN ensemble_agreement > 0.8e0 THEN 'Strong' WHEN ensemble_agreement > 0.6e0 THEN 'Good' ELSE 'Weak' END
         AS agreement_label, count(*) AS predictions FROM predictions GROUP BY 1""", "predictions")


def q_sensor_gauge(spark, d):
    s = fx.sensors(spark, d)
    return s.select("event_id", *[F.round(rules.sensor_gauge(c, c), 6).alias(f"{c}_gauge") for c in rules.SENSORS])


def _gauge_sql():
    cols = ", ".join(f"round(least(({c} - {lo}e0) / {span}e0 * 100.0e0, 100.0e0), 6) AS {c}_gauge"
                     for c, (lo, span) in rules.GAUGES.items())
    return with_views(f"SELECT event_id, {cols} FROM sensors", "sensors")


def q_fleet_dimension(spark, d):
    return fx.registry(spark, d).select("machine_id", "location", "type")


SQL_DIM = with_views("SELECT machine_id, location, type FROM registry", "registry")


QUERIES = {
    "dashboard_reports": (q_dashboard_reports, _dashboard_reports_sql()),
    "machines_at_risk_scored": (q_machines_at_risk_scored, SQL_AT_RISK),
    "factory_health": (q_factory_health, SQL_HEALTH),
    "factory_health_recent": (q_factory_health_recent, SQL_HEALTH_RECENT),
    "maintenance_schedule": (q_maintenance_schedule, SQL_SCHEDULE),
    "fleet_diagnostics": (q_fleet_diagnostics, SQL_DIAG),
    "dashboard_summary": (q_dashboard_summary, _dashboard_sql_final()),
    "prediction_stats": (q_prediction_stats, SQL_PSTATS),
    "hourly_distribution": (q_hourly_distribution, SQL_HOURLY),
    "machines_summary": (q_machines_summary, SQL_MSUMMARY),
    "machine_stats": (q_machine_stats, SQL_MSTATS),
    "fleet_overview": (q_fleet_overview, SQL_FLEET),
    "model_confidence": (q_model_confidence, SQL_CONF),
    "sensor_anomalies": (q_sensor_anomalies, SQL_ANOM),
    "anomaly_overview": (q_anomaly_overview, SQL_ANOM_OVERVIEW),
    "unresolved_failures": (q_unresolved_failures, SQL_UNRESOLVED),
    "newest_failure_per_machine": (q_newest_failure_per_machine, SQL_NEWEST),
    "oldest_failure_per_machine": (q_oldest_failure_per_machine, SQL_OLDEST),
    "at_risk_report": (q_at_risk_report, SQL_AT_RISK_REPORT),
    "failure_distribution": (q_failure_distribution, SQL_FAILDIST),
    "risk_distribution": (q_risk_distribution, SQL_RISKDIST),
    "urgency_counts": (q_urgency_counts, _urgency_counts_sql()),
    "pos_weight": (q_pos_weight, SQL_POSW),
    "telemetry_tail": (q_telemetry_tail, SQL_TELE),
    "tail_n": (q_tail_n, SQL_TAIL),
    "head_n": (q_head_n, SQL_HEAD),
    "sort_by_time": (q_sort_by_time, SQL_SORT),
    "time_split": (q_time_split, SQL_SPLIT),
    "sample_per_class": (q_sample_per_class, SQL_SAMPLE),
    "synthetic_ts": (q_synthetic_ts, SQL_SYNTH),
    "assign_fleet": (q_assign_fleet, SQL_FLEET_ASSIGN),
    "risk_band": (q_risk_band, SQL_BAND),
    "action_lookup": (q_action_lookup, SQL_ACTION),
    "parts_list": (q_parts_list, SQL_PARTS),
    "ensemble_agreement": (q_ensemble_agreement, SQL_AGREE),
    "agreement_label": (q_agreement_label, SQL_AGREE_LABEL),
    "sensor_gauge": (q_sensor_gauge, _gauge_sql()),
    "fleet_dimension": (q_fleet_dimension, SQL_DIM),
}
