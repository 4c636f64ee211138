"""Registered source / sink queries (S1-S15).  Each writes data derived from the
test tables below the shared checkpoint folder and reads it back by schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..functions import rules
from ..operators import reports
from ..session import scratch_path
from ..sources import files, machine_store, messages
from .base_sql import with_views

SENS = ", ".join(rules.SENSORS)
SENSOR_COLS = ["event_id", "machine_id", "ts", *rules.SENSORS, "type", "machine_failure"]


def q_scan_csv(spark, d):
    path = files.write_csv(fx.sensors(spark, d), name="scan-csv")
    return files.read_csv(spark, path, files.SENSOR_SCHEMA)


SQL_SENSORS = with_views(f"SELECT {', '.join(SENSOR_COLS)} FROM sensors", "sensors")


def q_sink_roundtrip(spark, d):
    """Bucketed Parquet sink, read back as a whole."""
    path = files.write_table(fx.sensors(spark, d), name="sink")
    return spark.read.parquet(path).select(*SENSOR_COLS)


SQL_SINK = with_views(f"SELECT {', '.join(SENSOR_COLS)} FROM sensors", "sensors")


def q_scan_csv_tolerant(spark, d):
    """S3: malformed lines (one per machine, derived from the data) are dropped."""
    s = fx.sensors(spark, d)
    text = s.select(*[F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if c == "ts"
                      else F.col(c).cast("string").alias(c) for c in SENSOR_COLS])
    bad = s.groupBy("machine_id").agg(F.max("ts").alias("ts")).select(
        F.lit("n/a").alias("event_id"), F.col("machine_id").cast("string").alias("machine_id"),
        F.lit("not-a-time").alias("ts"), *[F.lit("broken").alias(c) for c in rules.SENSORS],
        F.lit("?").alias("type"), F.lit("x").alias("machine_failure"))
    path = files.write_csv(text.unionByName(bad), name="tolerant")
    return files.read_csv(spark, path, files.SENSOR_SCHEMA, tolerant=True)


UPLOAD_SCHEMA = T.StructType([*[T.StructField(s, T.DoubleType()) for s in rules.SENSORS],
                              T.StructField(" Type ", T.StringType()), T.StructField("Event_ID", T.LongType())])


def q_upload_normalize(spark, d):
    s = fx.sensors(spark, d).select(*rules.SENSORS, F.col("type").alias(" Type "), F.col("event_id").alias("Event_ID"))
    path = files.write_csv(s, name="upload")
    raw = files.read_csv(spark, path, UPLOAD_SCHEMA)
    return files.upload_normalize(raw, prefix="LINE", now="2024-02-01 00:00:00")


SQL_UPLOAD = with_views(f"""
SELECT {SENS}, type, event_id, 'LINE_001' AS machine_id, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp"
FROM sensors""", "sensors")


def q_topic_message_parse(spark, d):
    s = fx.sensors(spark, d)
    msgs = s.select(F.format_string("factory/machines/%d/sensors", "machine_id").alias("topic"),
                    F.to_json(F.struct(*rules.SENSORS)).alias("payload"), F.col("ts").alias("arrival"))
    noise = s.groupBy("machine_id").agg(F.max("ts").alias("arrival")).select(
        F.format_string("status/%d", "machine_id").alias("topic"), F.lit("{}").alias("payload"), "arrival")
    path = files.write_json(msgs.unionByName(noise), name="topics", mode="overwrite")
    return messages.topic_message_parse(files.read_json(spark, path, messages.TOPIC_SCHEMA))


SQL_TOPIC = with_views(f"""
SELECT CAST(machine_id AS VARCHAR) AS machine_id, {SENS}, ts AS "timestamp" FROM sensors""", "sensors")


def q_fleet_doc_explode(spark, d):
    s = fx.sensors(spark, d)
    docs = s.groupBy(F.date_trunc("minute", "ts").alias("_m")).agg(
        F.collect_list(F.struct(F.col("machine_id").cast("string").alias("machine_id"), *rules.SENSORS)).alias("machines"),
        F.max("ts").alias("fetched_at")).drop("_m")
    path = files.write_json(docs, name="fleet-docs", mode="overwrite")
    return messages.fleet_doc_explode(files.read_json(spark, path, messages.FLEET_SCHEMA))


SQL_FLEET_DOC = with_views(f"""
SELECT CAST(machine_id AS VARCHAR) AS machine_id, {SENS},
       max(ts) OVER (PARTITION BY date_trunc('minute', ts)) AS "timestamp" FROM sensors""", "sensors")


def _live_readings(spark, d):
    s = fx.sensors(spark, d)
    return s.select(
        F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("  ")).otherwise(F.format_string(" machine_%d", "machine_id"))
        .alias("machine_id"),
        *[F.when((F.lit(c) == "torque") & (F.pmod("event_id", F.lit(5)) == 0), F.lit(None).cast("double"))
          .otherwise(F.col(c)).alias(c) for c in rules.SENSORS],
        F.when(F.pmod("event_id", F.lit(3)) == 0, F.lit(None).cast("string")).otherwise(F.lit("mqtt")).alias("source"),
        F.to_json(F.struct("type")).alias("metadata"), F.col("ts").alias("received_at"))


def q_live_ingest(spark, d):
    accepted, _rejected = messages.live_ingest(_live_readings(spark, d))
    return accepted


SQL_LIVE = with_views("""
SELECT trim(' machine_' || CAST(machine_id AS VARCHAR)) AS machine_id, air_temp, process_temp, rotational_speed,
       CASE WHEN event_id % 5 = 0 THEN 0.0e0 ELSE torque END AS torque, tool_wear,
       CASE WHEN event_id % 3 = 0 THEN 'api' ELSE 'mqtt' END AS source,
       '{"type":"' || type || '"}' AS metadata, ts AS received_at
FROM sensors WHERE event_id % 7 <> 0""", "sensors")


def q_latest_reading(spark, d):
    return messages.latest_reading(fx.sensors(spark, d))


SQL_LATEST = with_views(f"""
SELECT machine_id, event_id, ts, {SENS}, type, machine_failure FROM sensors
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) = 1""", "sensors")


def _flat_log(spark, d):
    return files.prediction_log_flat(fx.predictions(spark, d))


def q_prediction_log_flat(spark, d):
    return _flat_log(spark, d)


def _r(col, digits):
    return f"floor({col} * {10 ** digits}.0e0 + 0.5e0) / {10 ** digits}.0e0"


FLAT_SQL = f"""SELECT ts AS "timestamp", machine_id, prediction, {_r('failure_probability', 4)} AS failure_probability,
  {_r('normal_probability', 4)} AS normal_probability, risk_level, {_r('air_temp', 2)} AS air_temp,
  {_r('process_temp', 2)} AS process_temp, {_r('rotational_speed', 1)} AS rotational_speed,
  {_r('torque', 2)} AS torque, {_r('tool_wear', 1)} AS tool_wear, model_name,
  {_r('ensemble_agreement', 4)} AS ensemble_agreement FROM predictions"""

SQL_FLAT = with_views(FLAT_SQL, "predictions")


def q_prediction_log_nested(spark, d):
    path = files.write_json(files.prediction_log_nested(_flat_log(spark, d)), name="log-jsonl", mode="overwrite")
    back = files.read_json(spark, path, files.NESTED_LOG_SCHEMA)
    return back.select("timestamp", "machine_id", "prediction", "failure_probability", "risk_level",
                       *[F.col(f"sensors.{s}").alias(s) for s in rules.SENSORS], "model")


SQL_NESTED = with_views(f"""
SELECT "timestamp", machine_id, prediction, failure_probability, risk_level, {SENS}, model_name AS model
FROM ({FLAT_SQL}) x""", "predictions")


def q_export_history(spark, d):
    path = files.write_csv(_flat_log(spark, d), name="export", sort_by=["timestamp", "machine_id"])
    return files.read_csv(spark, path, files.PREDICTION_LOG_SCHEMA)


def q_registry_explode(spark, d):
    docs = files.registry_documents(fx.registry(spark, d).withColumn("name", F.format_string("Machine-%d", "machine_id")))
    path = scratch_path(spark, "registry-json")
    docs.write.text(path)
    out = files.registry_explode(spark.read.text(path))
    return out.select("key", "machine_id", "name", "location", "type", "status")


SQL_REGISTRY = with_views("""
SELECT printf('machine_%d', machine_id) AS key, machine_id, printf('Machine-%d', machine_id) AS name, location, type,
       status FROM registry""", "registry")


def q_machine_recent_predictions(spark, d):
    """S14 over the table by machine: lists of the newest 1000, of which the newest 100 are read."""
    path = machine_store.write_by_machine(machine_store.prediction_lists(fx.predictions(spark, d), 1000),
                                          scratch_path(spark, "machine-lists"))
    out = machine_store.last_predictions(spark.read.parquet(path), 100)
    return out.select("machine_id", "idx", "timestamp", "seq", "failure_probability", "risk_level")


SQL_RECENT = with_views("""
, k AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS rd FROM predictions)
, a AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) - 1 AS idx,
               count(*) OVER (PARTITION BY machine_id) AS n FROM k WHERE rd <= 1000)
SELECT machine_id, CAST(idx AS INTEGER) AS idx, ts AS "timestamp", event_id AS seq, failure_probability, risk_level
FROM a WHERE idx >= n - 100""", "predictions")


def q_machine_report(spark, d):
    scored = fx.predictions(spark, d)
    stats = reports.machine_stats(scored).select("machine_id", "total_predictions", "average_failure_probability",
                                                 "trend")
    rep = files.machine_report(fx.registry(spark, d), stats, scored, recent=200)
    return rep.select("machine_id", "location", "total_predictions", "average_failure_probability", "trend",
                      F.size("recent_predictions").alias("recent_count"),
                      F.col("recent_predictions")[0]["ts"].alias("newest_ts"),
                      (F.length("report") > 0).cast("int").alias("has_report"))


SQL_REPORT = with_views("""
, n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS ra,
               row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS rd FROM predictions)
, st AS (SELECT machine_id, count(*) AS total_predictions,
                round(avg(failure_probability), 4) AS average_failure_probability,
                CASE WHEN avg(CASE WHEN rd <= 50 THEN failure_probability END)
                        < avg(CASE WHEN ra <= 50 THEN failure_probability END) THEN 'improving' ELSE 'declining' END
                  AS trend,
                CAST(count_if(rd <= 200) AS INTEGER) AS recent_count, max(ts) AS newest_ts FROM n GROUP BY machine_id)
SELECT r.machine_id, r.location, st.total_predictions, st.average_failure_probability, st.trend, st.recent_count,
       st.newest_ts, 1 AS has_report
FROM registry r LEFT JOIN st ON r.machine_id = st.machine_id""", "predictions", "registry")


def q_machine_lookup(spark, d):
    """JN1: the whole record, with the newest 200 predictions, of every machine whose newest reading is at high risk."""
    scored = fx.predictions(spark, d)
    stats = reports.machine_stats(scored).select("machine_id", "total_predictions", "average_failure_probability", "trend")
    store = machine_store.MachineStore(spark, scratch_path(spark, "machine-store")).write(fx.registry(spark, d), stats, scored)
    risky = messages.latest_reading(scored.select("machine_id", "ts", "event_id", "failure_probability")).filter("failure_probability >= 0.5")
    rows = store.records(risky, recent=200)
    return rows.select("machine_id", "location", "total_predictions", "average_failure_probability", "trend",
                       F.posexplode("recent_predictions").alias("place", "r")).select(
        "machine_id", "location", "total_predictions", "average_failure_probability", "trend", "place",
        F.col("r.timestamp").alias("ts"), F.col("r.seq").alias("event_id"), F.col("r.failure_probability").alias("failure_probability"),
        F.col("r.sensor_data.torque").alias("torque"))


SQL_LOOKUP = with_views("""
, n AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, event_id) AS ra,
               row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) AS rd FROM predictions)
, st AS (SELECT machine_id, count(*) AS total_predictions, round(avg(failure_probability), 4) AS average_failure_probability,
                CASE WHEN avg(CASE WHEN rd <= 50 THEN failure_probability END)
                        < avg(CASE WHEN ra <= 50 THEN failure_probability END) THEN 'improving' ELSE 'declining' END AS trend,
                max(CASE WHEN rd = 1 THEN failure_probability END) AS newest FROM n GROUP BY machine_id)
SELECT r.machine_id, r.location, st.total_predictions, st.average_failure_probability, st.trend,
       CAST(n.rd - 1 AS INTEGER) AS place, n.ts, n.event_id, n.failure_probability, n.torque
FROM registry r JOIN st ON r.machine_id = st.machine_id JOIN n ON n.machine_id = r.machine_id
WHERE st.newest >= 0.5e0 AND n.rd <= 200""", "predictions", "registry")


def q_topic_message_rejects(spark, d):
    """S5, the quarantine: every 37th reading also comes on a short topic, every 41st with a payload cut off."""
    rows = fx.sensors(spark, d).select("event_id", F.format_string("factory/machines/%d/sensors", "machine_id").alias("topic"),
                                       F.to_json(F.struct(*rules.SENSORS)).alias("payload"))
    short = rows.filter(F.pmod("event_id", F.lit(37)) == 0).withColumn("topic", F.lit("factory/machines"))
    cut = rows.filter(F.pmod("event_id", F.lit(41)) == 0).withColumn("payload", F.lit("{cut off"))
    return messages.topic_message_rejects(rows.unionByName(short).unionByName(cut)).select("event_id", "topic", "reason")


SQL_TOPIC_REJECTS = with_views("""
SELECT event_id, 'factory/machines' AS topic, 'topic' AS reason FROM sensors WHERE event_id % 37 = 0
UNION ALL
SELECT event_id, printf('factory/machines/%d/sensors', machine_id), 'payload' FROM sensors WHERE event_id % 41 = 0""", "sensors")


def q_upload_summary(spark, d):
    """S4 result: record count and the machines of a normalised upload, read from CSV."""
    path = files.write_csv(fx.sensors(spark, d).select("machine_id", *[F.col(c).alias(f" {c.upper()} ") for c in rules.SENSORS]),
                           name="upload")
    schema = T.StructType([T.StructField("machine_id", T.LongType()), *[T.StructField(f" {c.upper()} ", T.DoubleType()) for c in rules.SENSORS]])
    upload = files.read_csv(spark, path, schema)
    named = files.upload_normalize(upload, required=[f" {c.upper()} " for c in rules.SENSORS], now="2024-01-01 00:00:00")
    return files.upload_summary(named).select("records", F.explode("machines").alias("machine"))


SQL_UPLOAD_SUMMARY = with_views("""
SELECT (SELECT count(*) FROM sensors) AS records, CAST(machine_id AS VARCHAR) AS machine FROM sensors GROUP BY machine_id""", "sensors")


QUERIES = {
    "scan_csv": (q_scan_csv, SQL_SENSORS),
    "sink_roundtrip": (q_sink_roundtrip, SQL_SINK),
    "scan_csv_tolerant": (q_scan_csv_tolerant, SQL_SENSORS),
    "upload_normalize": (q_upload_normalize, SQL_UPLOAD),
    "topic_message_parse": (q_topic_message_parse, SQL_TOPIC),
    "fleet_doc_explode": (q_fleet_doc_explode, SQL_FLEET_DOC),
    "live_ingest": (q_live_ingest, SQL_LIVE),
    "latest_reading": (q_latest_reading, SQL_LATEST),
    "prediction_log_flat": (q_prediction_log_flat, SQL_FLAT),
    "prediction_log_nested": (q_prediction_log_nested, SQL_NESTED),
    "export_history": (q_export_history, SQL_FLAT),
    "registry_explode": (q_registry_explode, SQL_REGISTRY),
    "machine_recent_predictions": (q_machine_recent_predictions, SQL_RECENT),
    "machine_report": (q_machine_report, SQL_REPORT),
    "machine_lookup": (q_machine_lookup, SQL_LOOKUP),
    "topic_message_rejects": (q_topic_message_rejects, SQL_TOPIC_REJECTS),
    "upload_summary": (q_upload_summary, SQL_UPLOAD_SUMMARY),
}
