"""Registered queries of the event-time streams and of state in buckets.

The stand-in input lands the given readings in three parts, each row up to a day late and some
of them twice; the stream runs once per part from one checkpoint.  Results hold the rows that the watermark has
passed at the end, as the SQL says it: younger rows still wait in the checkpoint for the next run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators import features, state
from ..operators.bucketed import BucketedTable
from ..plans import training
from ..session import scratch_path
from ..sources import fleet_polls, messages
from ..streaming import live, ordered
from .base_sql import with_views
from .state_q import SQL_UPSERT
from .streaming_q import SQL_LAST30

DELAY = "24 hours"
IDLE = "60 days"
SLICES = 3
TRAINED_UNTIL = "2024-01-20 00:00:00"
STATEFUL = ["air_temp_mean_6", "process_temp_mean_6", "rpm_std_6", "torque_std_6", "air_temp_lag1", "air_temp_lag2", "rpm_ema"]
NINE = [*STATEFUL, "temp_diff", "wear_torque"]


def arrivals(df: DataFrame, ts_col: str = "ts", id_col: str = "event_id") -> list[DataFrame]:
    """``df`` in three parts in the order of arrival, each row less than a day late, every eleventh twice."""
    late = F.timestamp_add("SECOND", F.pmod(F.xxhash64(id_col), F.lit(86000)).cast("int"), F.col(ts_col))
    again = F.timestamp_add("SECOND", F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(86000)).cast("int"), F.col(ts_col))
    both = df.withColumn("_arrival", late).unionByName(df.filter(F.pmod(F.col(id_col), F.lit(11)) == 0).withColumn("_arrival", again))
    return [s.drop("_arrival") for s in live.time_slices(both, SLICES, "_arrival")]


def _run(spark, name, parts, build):
    run = live.StreamRun(spark, name)
    for part in parts:
        run.land(part)
        run.run(build(run, run.source(parts[0].schema)))
    return run


def q_stream_ordered_features(spark, d):
    """K6: all nine features in event-time order, rows up to a day late."""
    run = _run(spark, "k6o", arrivals(fx.sensors(spark, d)), lambda r, src: ordered.ordered_features(src, DELAY, IDLE)
               .writeStream.outputMode("append").format("parquet").option("path", r.sink))
    return spark.read.parquet(run.sink).select("event_id", "machine_id", "ts", *[F.round(c, 6).alias(c) for c in NINE])


def _features_sql(until: str = "1") -> str:
    q, w = 1.0 - 2.0 / 7.0, "PARTITION BY machine_id ORDER BY ts, event_id"
    f = f"OVER ({w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    return f"""
, numbered AS (SELECT *, row_number() OVER ({w}) AS rn FROM sensors)
, ewm AS (SELECT a.event_id, sum(pow({q!r}, a.rn - b.rn) * b.rotational_speed) / sum(pow({q!r}, a.rn - b.rn)) AS rpm_ema
          FROM numbered a JOIN numbered b ON a.machine_id = b.machine_id AND b.rn <= a.rn GROUP BY a.event_id)
, feats AS (SELECT s.*, avg(air_temp) {f} AS air_temp_mean_6, avg(process_temp) {f} AS process_temp_mean_6,
  stddev_samp(rotational_speed) {f} AS rpm_std_6, stddev_samp(torque) {f} AS torque_std_6,
  lag(air_temp, 1) OVER ({w}) AS air_temp_lag1, lag(air_temp, 2) OVER ({w}) AS air_temp_lag2, rpm_ema,
  process_temp - air_temp AS temp_diff, tool_wear * torque AS wear_torque,
  CASE WHEN type = 'L' THEN 1.0e0 ELSE 0.0e0 END AS "Type_L", CASE WHEN type = 'M' THEN 1.0e0 ELSE 0.0e0 END AS "Type_M"
  FROM sensors s JOIN ewm USING (event_id))
, edge AS (SELECT max(ts) - INTERVAL {DELAY} AS edge FROM sensors)"""


SQL_ORDERED = with_views(_features_sql() + f"""
SELECT event_id, machine_id, ts, {', '.join(f'round({c}, 6) AS {c}' for c in NINE)}
FROM feats, edge WHERE ts < edge""", "sensors")


@dataclass
class LiveTables:
    """What the live job writes: the log of scored readings, the machine registry, the rejects."""
    spark: SparkSession
    log_root: str
    rejects_root: str
    registry: BucketedTable

    def log(self) -> DataFrame:
        return self.spark.read.parquet(self.log_root)

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(self.rejects_root)


def live_messages(sensors: DataFrame) -> DataFrame:
    """Stand-in readings: the given ones, and every 37th also without machine, every 41st without time."""
    rows = sensors.select(F.col("machine_id").cast("string").alias("machine_id"), *rules.SENSORS, F.lit(None).cast("string").alias("source"),
                          F.to_json(F.struct("event_id", "type")).alias("metadata"), F.col("ts").alias("received_at"), "event_id", "ts")
    blank = rows.filter(F.pmod(F.col("event_id"), F.lit(37)) == 0).withColumn("machine_id", F.lit(" "))
    timeless = rows.filter(F.pmod(F.col("event_id"), F.lit(41)) == 0).withColumn("received_at", F.lit(None).cast("timestamp_ntz"))
    return rows.unionByName(blank).unionByName(timeless)


def history(sensors: DataFrame) -> DataFrame:
    """Training rows for the live model: batch features until ``TRAINED_UNTIL``, nulls as 0."""
    typed = sensors.select("*", *[(F.col("type") == k).cast("double").alias(f"Type_{k}") for k in ("L", "M")])
    table = features.feature_pipeline(typed, fill=False)
    return table.filter(F.col("ts") < F.lit(TRAINED_UNTIL).cast("timestamp_ntz")).fillna(0.0, features.MODEL_FEATURES)


def run_live(spark: SparkSession, sensors: DataFrame, model) -> LiveTables:
    """The live job over the stand-in messages, started once per part from the same checkpoint."""
    run = live.StreamRun(spark, "k3-live")
    tables = LiveTables(spark, f"{run.sink}/log", f"{run.sink}/rejects",
                        BucketedTable(spark, f"{run.sink}/registry", ["machine_id"], 16))
    for part in arrivals(live_messages(sensors)):
        run.land(part.select(*messages.LIVE_SCHEMA.fieldNames()))
        for query in ordered.start_live_scoring(run.source(messages.LIVE_SCHEMA), model, features.MODEL_FEATURES, tables.log_root,
                                                tables.rejects_root, tables.registry, run.checkpoint, DELAY, IDLE):
            query.awaitTermination()
    return tables


def q_stream_live_scoring(spark, d):
    """K3: messages to ordered features to a fitted model's scores, logged; the model is fitted on the history."""
    sensors = fx.sensors(spark, d)
    model = Pipeline(stages=[VectorAssembler(inputCols=features.MODEL_FEATURES, outputCol="features"),
                             NaiveBayes(modelType="gaussian", labelCol=training.LABEL)]).fit(history(sensors))
    log = run_live(spark, sensors, model).log()
    return log.select("event_id", "machine_id", "ts", "prediction", "failure_probability", "risk_level", "source")


def _live_sql() -> str:
    cols = features.MODEL_FEATURES
    filled = ", ".join(f'coalesce("{c}", 0.0e0) AS "{c}"' for c in cols)
    moments = ", ".join(f'avg("{c}") AS "m_{c}", var_pop("{c}") AS "v_{c}"' for c in cols)
    widest = ", ".join(f'var_pop("{c}")' for c in cols)
    terms = " + ".join(f'(ln(v."v_{c}" + eps) + pow(x."{c}" - v."m_{c}", 2) / (v."v_{c}" + eps))' for c in cols)
    return with_views(_features_sql() + f"""
, x AS (SELECT event_id, machine_id, ts, machine_failure, {filled} FROM feats)
, past AS (SELECT * FROM x WHERE ts < TIMESTAMP '{TRAINED_UNTIL}')
, v AS (SELECT machine_failure AS class, count(*) AS n, {moments} FROM past GROUP BY 1)
, e AS (SELECT 1.0e-9 * greatest({widest}) AS eps, count(*) AS total FROM past)
, joint AS (SELECT x.event_id, v.class, ln(v.n / e.total) - 0.5e0 * ({terms}) AS ll FROM x, v, e)
, p AS (SELECT event_id, 1.0e0 / (1.0e0 + exp(least(700.0e0, max(ll) FILTER (class = 0) - max(ll) FILTER (class = 1)))) AS raw
        FROM joint GROUP BY 1)
, r AS (SELECT event_id, raw, round(raw, 6) AS failure_probability FROM p)
SELECT event_id, CAST(machine_id AS VARCHAR) AS machine_id, ts, CASE WHEN raw > 0.5e0 THEN 1 ELSE 0 END AS prediction, failure_probability,
       CASE WHEN failure_probability >= 0.8e0 THEN 'CRITICAL' WHEN failure_probability >= 0.5e0 THEN 'HIGH'
            WHEN failure_probability >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 'api' AS source
FROM x JOIN r USING (event_id), edge WHERE ts < edge""", "sensors")


def q_stream_rejects(spark, d):
    """S7 as a stream: the readings the live job does not take, with the reason."""
    run = live.StreamRun(spark, "k1-rejects")
    for part in arrivals(live_messages(fx.sensors(spark, d))):
        run.land(part.select(*messages.LIVE_SCHEMA.fieldNames()))
        run.run(ordered.live_rejects(run.source(messages.LIVE_SCHEMA)).writeStream.foreachBatch(ordered.reject_writer(run.sink)))
    out = spark.read.parquet(run.sink)
    return out.select("reason", "machine_id", F.get_json_object("metadata", "$.event_id").cast("long").alias("event_id"), "torque", "received_at")


SQL_REJECTS = with_views("""
, twice AS (SELECT * FROM sensors UNION ALL SELECT * FROM sensors WHERE event_id % 11 = 0)
SELECT 'machine' AS reason, ' ' AS machine_id, event_id, torque, ts AS received_at FROM twice WHERE event_id % 37 = 0
UNION ALL
SELECT 'time', CAST(machine_id AS VARCHAR), event_id, torque, NULL FROM twice WHERE event_id % 41 = 0""", "sensors")


def q_stream_latest_per_day(spark, d):
    """K7 in the stream: the latest arrival per machine and day, with state of the last day only."""
    mf = fx.machine_failures(spark, d).select("id", "timestamp", "machine_id", "failure_probability", "risk_level")
    run = _run(spark, "k7o", arrivals(mf, "timestamp", "id"), lambda r, src: ordered.latest_per_unit(src, "1 day", DELAY)
               .writeStream.outputMode("append").format("parquet").option("path", r.sink))
    return spark.read.parquet(run.sink)


SQL_LATEST_DAY = with_views(f"""
, edge AS (SELECT max("timestamp") - INTERVAL {DELAY} AS edge FROM machine_failures)
SELECT id, "timestamp", machine_id, failure_probability, risk_level FROM machine_failures, edge
WHERE date_trunc('day', "timestamp") + INTERVAL 1 DAY <= edge
QUALIFY row_number() OVER (PARTITION BY date_trunc('day', "timestamp"), machine_id ORDER BY id DESC) = 1""", "machine_failures")


def q_stream_windows(spark, d):
    """K8 in the stream: the newest 30 readings of each machine as state; a batch replaces its machines' rows in buckets."""
    s = fx.sensors(spark, d).select("event_id", "machine_id", "ts", "torque")
    table = BucketedTable(spark, scratch_path(spark, "k8-windows"), ["machine_id"], 16)
    _run(spark, "k8o", arrivals(s), lambda r, src: ordered.last_n(src, 30, DELAY, IDLE).writeStream.outputMode("update")
         .foreachBatch(ordered.window_writer(table, f"{r.sink}-staging")))
    return table.read()


def q_state_in_buckets(spark, d):
    """U1 over buckets of (day, machine): stored rows first, then the changes, which rewrite their buckets only."""
    mf = fx.machine_failures(spark, d).select("id", "timestamp", "machine_id", "failure_probability", "risk_level")
    early = F.col("timestamp") < F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    table = BucketedTable(spark, scratch_path(spark, "u1-buckets"), [F.date_trunc("day", F.col("timestamp")), "machine_id"], 32)
    table.upsert(mf.filter(early), ["id"])
    table.change(mf.filter(~early), lambda now, new: state.upsert_predictions(now, new, key_unit="day"))
    return table.read()


def q_stream_fleet_documents(spark, d):
    """K1 over S6: polled documents from the polling source, readings and rejects kept side by side."""
    s = fx.sensors(spark, d)
    machine = F.when(F.pmod(F.col("event_id"), F.lit(37)) == 0, F.lit(" ")).otherwise(F.col("machine_id").cast("string"))
    docs = s.groupBy(F.date_trunc("minute", "ts").alias("_m")).agg(
        F.collect_list(F.struct(machine.alias("machine_id"), *rules.SENSORS)).alias("machines"), F.max("ts").alias("fetched_at"))
    text = F.to_json(F.struct("machines", "fetched_at"), {"timestampNTZFormat": live.TS_FORMAT})
    run, root = live.StreamRun(spark, "k1-fleet"), scratch_path(spark, "fleet-polls")
    for part in live.time_slices(docs, SLICES, "_m"):
        fleet_polls.land_poll(part.select(text.alias("document")), root)
        rows = fleet_polls.fleet_readings(fleet_polls.fleet_documents(spark, root))
        run.run(rows.writeStream.foreachBatch(fleet_polls.two_outputs_writer(run.sink)))
    readings, rejects = fleet_polls.outputs(spark, run.sink)
    refused = rejects.select("reason", "timestamp", F.get_json_object("document", "$.torque").cast("double").alias("torque"))
    return readings.drop("poll").withColumn("reason", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)


SQL_FLEET = with_views(f"""
, polled AS (SELECT *, event_id % 37 = 0 AS blank, max(ts) OVER (PARTITION BY date_trunc('minute', ts)) AS polled_at FROM sensors)
SELECT CASE WHEN NOT blank THEN CAST(machine_id AS VARCHAR) END AS machine_id,
       {', '.join(f'CASE WHEN NOT blank THEN {c} END AS {c}' if c != 'torque' else 'torque' for c in rules.SENSORS)},
       polled_at AS "timestamp", CASE WHEN blank THEN 'machine' END AS reason FROM polled""", "sensors")


QUERIES = {
    "stream_fleet_documents": (q_stream_fleet_documents, SQL_FLEET),
    "stream_ordered_features": (q_stream_ordered_features, SQL_ORDERED),
    "stream_live_scoring": (q_stream_live_scoring, _live_sql()),
    "stream_rejects": (q_stream_rejects, SQL_REJECTS),
    "stream_latest_per_day": (q_stream_latest_per_day, SQL_LATEST_DAY),
    "stream_windows": (q_stream_windows, SQL_LAST30),
    "state_in_buckets": (q_state_in_buckets, SQL_UPSERT),
}
