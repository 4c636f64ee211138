"""Registered streaming queries.

Each query lands the sensor-derived rows in three event-time slices and runs
its stream once per slice from the same checkpoint (availableNow), so state
carries across restarts; the final sink is returned as a batch DataFrame and
checked against the batch oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators.bucketed import BucketedTable
from ..plans import scoring
from ..session import scratch_path
from ..sources import messages
from ..streaming import live
from .base_sql import with_views
from .sources_q import SQL_TOPIC, SQL_LATEST, SQL_SENSORS, SENSOR_COLS
from .state_q import SQL_UPSERT

SLICES = 3
SENS = ", ".join(rules.SENSORS)


def _sliced_run(spark, d, name, frame, build, fmt="parquet"):
    run = live.StreamRun(spark, name)
    schema = frame.schema
    for part in live.time_slices(frame, SLICES, "ts" if "ts" in frame.columns else "arrival"):
        run.land(part, fmt)
        run.run(build(run, run.source(schema, fmt)))
    return run


def q_stream_ingest(spark, d):
    s = fx.sensors(spark, d)
    msgs = s.select(F.format_string("factory/machines/%d/sensors", "machine_id").alias("topic"),
                    F.to_json(F.struct(*rules.SENSORS)).alias("payload"), F.col("ts").alias("arrival"))
    run = _sliced_run(spark, d, "k1", msgs, lambda r, src: live.ingest_topics(src).writeStream
                      .format("parquet").option("path", r.sink), fmt="json")
    return spark.read.parquet(run.sink)


def q_stream_latest(spark, d):
    """K2: the machines a batch changed replace their rows in buckets; nothing is kept on the driver."""
    table = BucketedTable(spark, scratch_path(spark, "k2-latest"), ["machine_id"], 16)
    _sliced_run(spark, d, "k2", fx.sensors(spark, d).select(*SENSOR_COLS),
                lambda r, src: live.latest_per_machine(src).writeStream.outputMode("update")
                .foreachBatch(live.latest_writer(table, f"{r.sink}-staging")))
    return table.read().select("machine_id", "event_id", "ts", *rules.SENSORS, "type", "machine_failure")


def q_stream_score_log(spark, d):
    readings = f"{live.StreamRun(spark, 'k3-readings').sink}"
    preds = f"{live.StreamRun(spark, 'k3-predictions').sink}"
    _sliced_run(spark, d, "k3", fx.sensors(spark, d).select(*SENSOR_COLS),
                lambda r, src: src.writeStream.foreachBatch(live.score_and_log_writer(readings, preds)))
    return spark.read.parquet(preds).select("event_id", "machine_id", "ts", "failure_probability", "risk_level",
                                            "ensemble_agreement")


SQL_SCORE_LOG = with_views("""
SELECT event_id, machine_id, ts, failure_probability, risk_level, ensemble_agreement FROM predictions""",
                           "predictions")


def q_stream_risk_counts(spark, d):
    run = _sliced_run(spark, d, "k4", fx.sensors(spark, d).select(*SENSOR_COLS),
                      lambda r, src: live.risk_counts(scoring.score_linear(src)).writeStream.outputMode("update")
                      .foreachBatch(live.batch_folder_writer(r.sink)))
    updates = spark.read.parquet(run.sink)
    return updates.groupBy("risk_level").agg(F.max_by("count", "batch").alias("count"))


SQL_RISK_COUNTS = with_views("SELECT risk_level, count(*) AS count FROM predictions GROUP BY risk_level",
                             "predictions")


def q_stream_hourly(spark, d):
    run = _sliced_run(spark, d, "k5", fx.sensors(spark, d).select(*SENSOR_COLS),
                      lambda r, src: live.hourly_counts(src).writeStream.outputMode("update")
                      .foreachBatch(live.batch_folder_writer(r.sink)))
    updates = spark.read.parquet(run.sink)
    latest = updates.groupBy("window_start").agg(F.max_by("predictions", "batch").alias("predictions"))
    return latest.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "predictions")


SQL_HOURLY = with_views("""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS predictions FROM sensors GROUP BY 1""", "sensors")


def q_stream_features(spark, d):
    run = _sliced_run(spark, d, "k6", fx.sensors(spark, d).select(*SENSOR_COLS),
                      lambda r, src: live.stateful_features(src).writeStream.outputMode("append")
                      .format("parquet").option("path", r.sink))
    out = spark.read.parquet(run.sink)
    return out.select("event_id", "machine_id", "ts",
                      *[F.round(c, 6).alias(c) for c in ("air_temp_mean_6", "rpm_std_6", "air_temp_lag1",
                                                          "air_temp_lag2", "rpm_ema")])


def _stream_features_sql():
    q = 1.0 - 2.0 / 7.0
    w = "PARTITION BY machine_id ORDER BY ts, event_id"
    return with_views(f"""
, numbered AS (SELECT *, row_number() OVER ({w}) AS rn FROM sensors)
, ewm AS (SELECT a.event_id, sum(pow({q!r}, a.rn - b.rn) * b.rotational_speed) / sum(pow({q!r}, a.rn - b.rn)) AS e
          FROM numbered a JOIN numbered b ON a.machine_id = b.machine_id AND b.rn <= a.rn GROUP BY a.event_id)
SELECT event_id, machine_id, ts,
  round(avg(air_temp) OVER ({w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS air_temp_mean_6,
  round(stddev_samp(rotational_speed) OVER ({w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS rpm_std_6,
  round(lag(air_temp, 1) OVER ({w}), 6) AS air_temp_lag1, round(lag(air_temp, 2) OVER ({w}), 6) AS air_temp_lag2,
  round(e, 6) AS rpm_ema
FROM sensors JOIN ewm USING (event_id)""", "sensors")


def q_stream_dedup(spark, d):
    mf = fx.machine_failures(spark, d).withColumn("ts", F.col("timestamp"))
    run = _sliced_run(spark, d, "k7", mf,
                      lambda r, src: src.writeStream.foreachBatch(live.batch_folder_writer(r.sink)))
    out = live.dedup_latest(spark.read.parquet(run.sink).drop("ts"))
    return out.select("id", "timestamp", "machine_id", "failure_probability", "risk_level")


def q_stream_last30(spark, d):
    run = _sliced_run(spark, d, "k8", fx.sensors(spark, d).select(*SENSOR_COLS),
                      lambda r, src: src.writeStream.foreachBatch(live.batch_folder_writer(r.sink)))
    out = live.last_n_per_machine(spark.read.parquet(run.sink).drop("batch"), 30)
    return out.select("event_id", "machine_id", "ts", "torque")


SQL_LAST30 = with_views("""
SELECT event_id, machine_id, ts, torque FROM sensors
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY ts DESC, event_id DESC) <= 30""", "sensors")


def q_stream_buffer_append(spark, d):
    run = _sliced_run(spark, d, "s9", fx.sensors(spark, d).select(*SENSOR_COLS),
                      lambda r, src: src.writeStream.foreachBatch(live.batch_folder_writer(r.sink)))
    return spark.read.parquet(run.sink).select(*SENSOR_COLS)


QUERIES = {
    "stream_ingest": (q_stream_ingest, SQL_TOPIC),
    "stream_latest": (q_stream_latest, SQL_LATEST),
    "stream_score_log": (q_stream_score_log, SQL_SCORE_LOG),
    "stream_risk_counts": (q_stream_risk_counts, SQL_RISK_COUNTS),
    "stream_hourly": (q_stream_hourly, SQL_HOURLY),
    "stream_features": (q_stream_features, _stream_features_sql()),
    "stream_dedup": (q_stream_dedup, SQL_UPSERT),
    "stream_last30": (q_stream_last30, SQL_LAST30),
    "stream_buffer_append": (q_stream_buffer_append, SQL_SENSORS),
}
