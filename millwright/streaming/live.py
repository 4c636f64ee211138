"""Structured Streaming operators.

Sources are landed files read with ``readStream`` (Kafka where deployed: the
parsing functions take the same (topic, payload) columns).  Every query runs
with ``trigger(availableNow=True)`` and a checkpoint below the shared
checkpoint folder, so a restart continues where it stopped and adds nothing
twice.  File sinks written from ``foreachBatch`` use one folder per batch id
(overwritten on replay), which makes them repeat-safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import rules
from ..operators import state as state_ops
from ..operators.bucketed import BucketedTable
from ..plans import scoring
from ..session import scratch_path
from ..sources import messages


TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


class StreamRun:
    """Landing folder + checkpoint + sink folder of one streaming job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.landing = scratch_path(spark, f"{name}-landing")
        self.checkpoint = scratch_path(spark, f"{name}-checkpoint")
        self.sink = scratch_path(spark, f"{name}-sink")

    def land(self, df: DataFrame, fmt: str = "parquet") -> None:
        df.write.mode("append").format(fmt).option("timestampNTZFormat", TS_FORMAT).save(self.landing)

    def source(self, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(schema).format(fmt).option("timestampNTZFormat", TS_FORMAT)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.load(self.landing)

    def run(self, writer, timeout_s: int | None = None) -> None:
        q = writer.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            q.stop()
            raise TimeoutError("streaming query did not finish in time")
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


def time_slices(df: DataFrame, n: int, ts_col: str = "ts") -> list[DataFrame]:
    """Split a frame into ``n`` contiguous event-time slices (bounds from one tiny aggregate)."""
    b = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    if b["lo"] is None:
        return [df]
    lo, hi = b["lo"], b["hi"]
    step = (hi - lo) / n
    cuts = [lo + step * i for i in range(1, n)]
    out, prev = [], None
    for c in cuts + [None]:
        cond = F.lit(True) if prev is None else (F.col(ts_col) >= F.lit(prev))
        if c is not None:
            cond = cond & (F.col(ts_col) < F.lit(c))
        out.append(df.filter(cond))
        prev = c
    return out


def event_time(df: DataFrame, ts_col: str = "ts", out: str = "event_time") -> DataFrame:
    """``withWatermark`` needs TIMESTAMP (not TIMESTAMP_NTZ): cast in the session zone."""
    return df.withColumn(out, F.col(ts_col).cast("timestamp"))


# --------------------------------------------------------------------------
# Ingest streams
# --------------------------------------------------------------------------

def ingest_topics(stream: DataFrame) -> DataFrame:
    """K1: parse (topic, payload, arrival) messages as they arrive."""
    return messages.topic_message_parse(stream)


# --------------------------------------------------------------------------
# K2 / K4 / K5 aggregations
# --------------------------------------------------------------------------

def latest_per_machine(stream: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """K2: streaming max_by per machine (complete / update mode)."""
    others = [c for c in stream.columns if c != "machine_id"]
    return stream.groupBy("machine_id").agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")) \
        .select("machine_id", *[F.col(f"r.{c}").alias(c) for c in others])


def latest_writer(table: BucketedTable, staging: str, order=("ts", "event_id")):
    """K2 sink, a ``foreachBatch`` body: newest rows by ``order`` go into the buckets of their machines; a replay changes nothing.

    The batch is written to ``staging`` once, so that the stream's state is not computed again for each use.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(staging)
        table.upsert(batch.sparkSession.read.schema(batch.schema).parquet(staging), order)
    return write


def risk_counts(scored_stream: DataFrame) -> DataFrame:
    """K4: running counts per risk level."""
    return scored_stream.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))


def hourly_counts(stream: DataFrame, ts_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """K5: event-time tumbling hourly counts with a watermark for late data."""
    et = event_time(stream, ts_col).withWatermark("event_time", delay)
    return et.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("predictions")) \
        .select(F.col("w.start").alias("window_start"), "predictions")


# --------------------------------------------------------------------------
# K6: stateful per-machine features (applyInPandasWithState)
# --------------------------------------------------------------------------

FEATURE_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("machine_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("air_temp_mean_6", T.DoubleType()), T.StructField("rpm_std_6", T.DoubleType()),
    T.StructField("air_temp_lag1", T.DoubleType()), T.StructField("air_temp_lag2", T.DoubleType()),
    T.StructField("rpm_ema", T.DoubleType()),
])
FEATURE_STATE = T.StructType([
    T.StructField("air", T.ArrayType(T.DoubleType())), T.StructField("rpm", T.ArrayType(T.DoubleType())),
    T.StructField("ew_n", T.DoubleType()), T.StructField("ew_d", T.DoubleType()),
])


def _feature_state_fn(window: int = 6, span: float = 6.0):
    q = 1.0 - 2.0 / (span + 1.0)

    def fn(key, frames: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        if st.exists:
            air, rpm, ew_n, ew_d = st.get
            air, rpm = [float(v) for v in air], [float(v) for v in rpm]
        else:
            air, rpm, ew_n, ew_d = [], [], 0.0, 0.0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        k = len(air)
        # carried history + this batch, vectorised rolling / lag (history gives the look-back)
        a_all = pd.Series(air + rows["air_temp"].astype(float).tolist())
        r_all = pd.Series(rpm + rows["rotational_speed"].astype(float).tolist())
        res = rows[["event_id", "machine_id", "ts"]].copy()
        res["air_temp_mean_6"] = pd.array(a_all.rolling(window, min_periods=1).mean().to_numpy()[k:], dtype="Float64")
        res["rpm_std_6"] = pd.array(r_all.rolling(window, min_periods=1).std().to_numpy()[k:], dtype="Float64")
        res["air_temp_lag1"] = pd.array(a_all.shift(1).to_numpy()[k:], dtype="Float64")
        res["air_temp_lag2"] = pd.array(a_all.shift(2).to_numpy()[k:], dtype="Float64")
        # the EWM recurrence carries (N, D) across batches: N' = qN + x, D' = qD + 1
        ema = []
        for r in r_all.to_numpy()[k:]:
            ew_n, ew_d = q * ew_n + float(r), q * ew_d + 1.0
            ema.append(ew_n / ew_d)
        res["rpm_ema"] = pd.array(ema, dtype="Float64")
        st.update((a_all.tolist()[-window:], r_all.tolist()[-window:], ew_n, ew_d))
        yield res
    return fn


def stateful_features(stream: DataFrame, window: int = 6, span: float = 6.0) -> DataFrame:
    """K6: rolling / lag / EWM features per machine carried across micro-batches."""
    return stream.groupBy("machine_id").applyInPandasWithState(
        _feature_state_fn(window, span), FEATURE_OUT, FEATURE_STATE, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------------
# foreachBatch sinks: K3, K7, K8, S9
# --------------------------------------------------------------------------

def batch_folder_writer(root: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """``foreachBatch`` body writing each batch to ``root/batch=<id>`` (overwrite = replay-safe)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch_id}")
    return write


def score_and_log_writer(readings_root: str, predictions_root: str):
    """K3: append readings and their scored predictions under the same batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{readings_root.rstrip('/')}/batch={batch_id}")
        scoring.score_linear(batch).write.mode("overwrite").parquet(f"{predictions_root.rstrip('/')}/batch={batch_id}")
    return write


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def dedup_latest(batches: DataFrame, key_unit: str = "day", ts_col: str = "timestamp",
                 arrival: str = "id") -> DataFrame:
    """K7: replace duplicates on (truncated time, machine) - the later arrival wins."""
    return state_ops.keep_latest(batches.drop("batch") if "batch" in batches.columns else batches,
                                 [F.date_trunc(key_unit, F.col(ts_col)), "machine_id"], [arrival])


def last_n_per_machine(readings: DataFrame, n: int = 30, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """K8: the live chart's sliding window - newest ``n`` readings per machine at read time."""
    from ..operators.features import retain_last_n
    return retain_last_n(readings, n, order, ["machine_id"])


SENSOR_STREAM_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("machine_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), *[T.StructField(s, T.DoubleType()) for s in rules.SENSORS],
    T.StructField("type", T.StringType()), T.StructField("machine_failure", T.IntegerType()),
])
