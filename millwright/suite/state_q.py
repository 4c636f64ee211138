"""Registered keyed-state queries (U*, A14) over the failure / registry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import reports, state
from ..session import scratch_path
from .base_sql import with_views

CUT = "2024-01-08 00:00:00"


def q_upsert_predictions(spark, d):
    """U1 keyed by (day, machine) - second-level duplicates hardly occur in the fixture."""
    mf = fx.machine_failures(spark, d)
    before = mf.filter(F.col("timestamp") < F.lit(CUT).cast("timestamp_ntz"))
    after = mf.filter(F.col("timestamp") >= F.lit(CUT).cast("timestamp_ntz"))
    out = state.upsert_predictions(before, after, key_unit="day")
    return out.select("id", "timestamp", "machine_id", "failure_probability", "risk_level")


SQL_UPSERT = with_views("""
SELECT id, "timestamp", machine_id, failure_probability, risk_level FROM machine_failures
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', "timestamp"), machine_id
                           ORDER BY "timestamp" >= TIMESTAMP '2024-01-08 00:00:00' DESC, id DESC) = 1""",
                        "machine_failures")


def q_registry_upsert(spark, d):
    s = fx.sensors(spark, d)
    early = s.filter(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))
    reg = early.groupBy("machine_id").agg(F.min("ts").alias("created_timestamp"), F.max("ts").alias("last_seen")) \
        .select("machine_id", "created_timestamp", "last_seen", F.lit("OPERATIONAL").alias("status"),
                F.lit("Floor 1").alias("location"), F.lit("CNC Machine").alias("type"))
    late = s.filter(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    return state.registry_upsert(reg, late)


SQL_REG_UPSERT = with_views(f"""
, early AS (SELECT machine_id, min(ts) AS c, max(ts) AS l FROM sensors WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1)
, late AS (SELECT machine_id, min(ts) AS f, max(ts) AS l FROM sensors WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1)
SELECT coalesce(e.machine_id, x.machine_id) AS machine_id, coalesce(e.c, x.f) AS created_timestamp,
       greatest(e.l, x.l) AS last_seen, 'OPERATIONAL' AS status,
       CASE WHEN e.machine_id IS NOT NULL THEN 'Floor 1' END AS location,
       CASE WHEN e.machine_id IS NOT NULL THEN 'CNC Machine' END AS type
FROM early e FULL OUTER JOIN late x ON e.machine_id = x.machine_id""", "sensors")


def _resolved(spark, d):
    return state.resolve_failures(fx.machine_failures(spark, d), fx.resolutions(spark, d))


def q_resolve_failures(spark, d):
    return _resolved(spark, d).select("id", "machine_id", "resolved", "resolved_timestamp", "resolved_by", "notes")


RESOLVED_SQL = """SELECT f.id, f."timestamp", f.machine_id, f.prediction, f.risk_level,
       CASE WHEN f.hit THEN 1 ELSE f.resolved END AS resolved,
       CASE WHEN f.hit THEN r.resolved_timestamp ELSE f.resolved_timestamp END
         AS resolved_timestamp,
       CASE WHEN f.hit THEN r.resolved_by ELSE f.resolved_by END AS resolved_by,
       CASE WHEN f.hit THEN r.notes ELSE f.notes END AS notes
FROM (SELECT x.*, coalesce(x.resolved = 0 AND x.prediction = 1 AND x."timestamp" <= y.resolved_timestamp, false) AS hit
      FROM machine_failures x LEFT JOIN resolutions y ON x.machine_id = y.machine_id) f
LEFT JOIN resolutions r ON f.machine_id = r.machine_id"""

SQL_RESOLVE = with_views(f"""
SELECT id, machine_id, resolved, resolved_timestamp, resolved_by, notes FROM ({RESOLVED_SQL})""",
                         "machine_failures", "resolutions")


def _current_registry(spark, d):
    p = fx.predictions(spark, d).filter(F.col("prediction") == 1)
    return p.groupBy("machine_id").agg(F.min("ts").alias("resolved_timestamp")).select(
        "machine_id", "resolved_timestamp", F.lit("operator").alias("resolved_by"), F.lit("first").alias("notes"),
        F.lit(1).alias("reactivated"), F.col("resolved_timestamp").alias("reactivated_timestamp"))


CURRENT_SQL = """SELECT machine_id, min(ts) AS resolved_timestamp, 'operator' AS resolved_by, 'first' AS notes,
       1 AS reactivated, min(ts) AS reactivated_timestamp FROM predictions WHERE prediction = 1 GROUP BY machine_id"""

UPSERTED_SQL = """SELECT coalesce(n.machine_id, c.machine_id) AS machine_id,
       CASE WHEN n.machine_id IS NOT NULL THEN n.resolved_timestamp ELSE c.resolved_timestamp END AS resolved_timestamp,
       CASE WHEN n.machine_id IS NOT NULL THEN n.resolved_by ELSE c.resolved_by END AS resolved_by,
       CASE WHEN n.machine_id IS NOT NULL THEN n.notes ELSE c.notes END AS notes,
       CASE WHEN n.machine_id IS NOT NULL THEN 0 ELSE c.reactivated END AS reactivated,
       CASE WHEN n.machine_id IS NOT NULL THEN NULL ELSE c.reactivated_timestamp END AS reactivated_timestamp
FROM current_reg c FULL OUTER JOIN resolutions n ON c.machine_id = n.machine_id"""


def _upserted(spark, d):
    return state.resolution_upsert(_current_registry(spark, d), fx.resolutions(spark, d))


def q_resolution_upsert(spark, d):
    return _upserted(spark, d)


SQL_RES_UPSERT = with_views(f"""
, current_reg AS ({CURRENT_SQL})
{UPSERTED_SQL}""", "predictions", "resolutions")


def q_resolved_semi_join(spark, d):
    p = fx.predictions(spark, d).filter(F.col("prediction") == 1).select("event_id", "machine_id", "ts")
    return state.resolved_machines(p, _upserted(spark, d))


SQL_SEMI = with_views(f"""
, current_reg AS ({CURRENT_SQL})
, reg AS ({UPSERTED_SQL})
SELECT event_id, machine_id, ts FROM predictions p WHERE prediction = 1
  AND machine_id IN (SELECT machine_id FROM reg WHERE reactivated = 0)""", "predictions", "resolutions")


def q_purge_resolved(spark, d):
    """U6 after U3: drop resolutions older than one day before the newest reading."""
    res = _resolved(spark, d)
    now = fx.sensors(spark, d).agg(F.max("ts").alias("_now"))
    out = state.purge_resolved(res.crossJoin(F.broadcast(now)), F.col("_now"), 1).drop("_now")
    return out.select("id", "machine_id", "resolved", "resolved_timestamp")


SQL_PURGE = with_views(f"""
SELECT id, machine_id, resolved, resolved_timestamp FROM ({RESOLVED_SQL}) x
WHERE NOT (resolved = 1 AND resolved_timestamp IS NOT NULL
           AND resolved_timestamp < (SELECT max(ts) FROM sensors) - INTERVAL 1 DAY)""",
                       "machine_failures", "resolutions")


def q_purge_count(spark, d):
    """The rows removed and kept by the purge."""
    now = fx.sensors(spark, d).agg(F.max("ts").alias("_now"))
    return state.purge_count(_resolved(spark, d).crossJoin(F.broadcast(now)), F.col("_now"), 1)


SQL_PURGE_COUNT = with_views(f"""
, old AS (SELECT coalesce(resolved = 1 AND resolved_timestamp < (SELECT max(ts) FROM sensors) - INTERVAL 1 DAY, false) AS gone
          FROM ({RESOLVED_SQL}) x)
SELECT count_if(gone) AS removed, count_if(NOT gone) AS kept FROM old""", "machine_failures", "resolutions")


def q_committed_state(spark, d):
    """U1 and U3 committed as two versions of one table; the reader gets the current one."""
    mf = fx.machine_failures(spark, d)
    store = state.VersionedTable(spark, scratch_path(spark, "failure-store"))
    store.commit(mf)
    version = store.commit(state.resolve_failures(store.read(), fx.resolutions(spark, d)), expected=1)
    return store.read().select("id", "machine_id", "resolved", "resolved_by").withColumn("version", F.lit(version))


SQL_COMMITTED = with_views(f"""
SELECT id, machine_id, resolved, resolved_by, 2 AS version FROM ({RESOLVED_SQL}) x""", "machine_failures", "resolutions")


def q_store_statistics(spark, d):
    return reports.store_statistics(_resolved(spark, d), fx.registry(spark, d))


SQL_STORE = with_views(f"""
SELECT count_if(prediction = 1) AS total_failures, count_if(resolved = 0 AND prediction = 1) AS unresolved_failures,
       count_if(resolved = 0 AND prediction = 1 AND risk_level = 'CRITICAL') AS unresolved_critical,
       count_if(resolved = 0 AND prediction = 1 AND risk_level = 'HIGH') AS unresolved_high,
       count_if(resolved = 0 AND prediction = 1 AND risk_level = 'MEDIUM') AS unresolved_medium,
       count_if(resolved = 0 AND prediction = 1 AND risk_level = 'LOW') AS unresolved_low,
       (SELECT count(*) FROM registry) AS machines FROM ({RESOLVED_SQL}) x""", "machine_failures", "resolutions", "registry")


def q_registry_set_maintenance(spark, d):
    scored = fx.predictions(spark, d)
    sched = reports.maintenance_schedule(scored, top=None).filter(F.col("priority") <= 2)
    now = scored.agg(F.max("ts").alias("_at"))
    reg = fx.registry(spark, d).crossJoin(F.broadcast(now))
    out = state.registry_set_maintenance(reg, sched, F.col("_at")).drop("_at")
    return out.select("machine_id", F.col("next_scheduled_maintenance.date").alias("next_date"),
                      F.col("next_scheduled_maintenance.type").alias("next_type"),
                      F.col("next_scheduled_maintenance.scheduled_at").alias("next_scheduled_at"))


SQL_SET_MAINT = with_views("""
, g AS (SELECT machine_id, avg(failure_probability) a, max(failure_probability) m FROM predictions GROUP BY machine_id)
, u AS (SELECT *, CASE WHEN m >= 0.8e0 THEN 1 WHEN m >= 0.6e0 THEN 2 WHEN a >= 0.4e0 THEN 3 ELSE 4 END AS pr,
               CASE WHEN m >= 0.8e0 THEN 0 WHEN m >= 0.6e0 THEN 2 WHEN a >= 0.4e0 THEN 7 ELSE 14 END AS days,
               CASE WHEN m >= 0.8e0 THEN 'Emergency Repair' WHEN m >= 0.6e0 THEN 'Urgent Servicing'
                    WHEN a >= 0.4e0 THEN 'Preventive Maintenance' ELSE 'Routine Inspection' END AS mt,
               (SELECT max(ts) FROM predictions) AS base FROM g)
SELECT r.machine_id, CASE WHEN u.pr <= 2 THEN strftime(u.base + to_days(u.days), '%Y-%m-%d') END AS next_date,
       CASE WHEN u.pr <= 2 THEN u.mt END AS next_type, CASE WHEN u.pr <= 2 THEN u.base END AS next_scheduled_at
FROM registry r LEFT JOIN u ON r.machine_id = u.machine_id""", "predictions", "registry")


def q_registry_set_status(spark, d):
    at_risk = reports.machines_at_risk(fx.predictions(spark, d), top=None)
    changes = at_risk.select("machine_id", F.lit("AT_RISK").alias("status"))
    return state.registry_set_status(fx.registry(spark, d), changes).select("machine_id", "status")


SQL_SET_STATUS = with_views("""
SELECT r.machine_id, CASE WHEN a.machine_id IS NOT NULL THEN 'AT_RISK' ELSE r.status END AS status
FROM registry r LEFT JOIN (SELECT machine_id FROM predictions GROUP BY machine_id
                           HAVING avg(failure_probability) >= 0.3e0) a ON r.machine_id = a.machine_id""",
                              "predictions", "registry")


QUERIES = {
    "upsert_predictions": (q_upsert_predictions, SQL_UPSERT),
    "registry_upsert": (q_registry_upsert, SQL_REG_UPSERT),
    "resolve_failures": (q_resolve_failures, SQL_RESOLVE),
    "resolution_upsert": (q_resolution_upsert, SQL_RES_UPSERT),
    "resolved_semi_join": (q_resolved_semi_join, SQL_SEMI),
    "purge_resolved": (q_purge_resolved, SQL_PURGE),
    "purge_count": (q_purge_count, SQL_PURGE_COUNT),
    "committed_state": (q_committed_state, SQL_COMMITTED),
    "store_statistics": (q_store_statistics, SQL_STORE),
    "registry_set_maintenance": (q_registry_set_maintenance, SQL_SET_MAINT),
    "registry_set_status": (q_registry_set_status, SQL_SET_STATUS),
}
