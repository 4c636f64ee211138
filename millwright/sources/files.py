"""File sources and sinks (S1-S4, S10-S15): explicit schemas, no inference.

Writers put their output below the shared checkpoint folder (or a caller
path); readers always pass a schema so a scan never reads the data twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..session import scratch_path

SENSOR_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("machine_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    *[T.StructField(s, T.DoubleType()) for s in rules.SENSORS],
    T.StructField("type", T.StringType()), T.StructField("machine_failure", T.IntegerType()),
])

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("machine_id", T.LongType()),
    T.StructField("prediction", T.IntegerType()), T.StructField("failure_probability", T.DoubleType()),
    T.StructField("normal_probability", T.DoubleType()), T.StructField("risk_level", T.StringType()),
    *[T.StructField(s, T.DoubleType()) for s in rules.SENSORS],
    T.StructField("model_name", T.StringType()), T.StructField("ensemble_agreement", T.DoubleType()),
])

NESTED_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("machine_id", T.LongType()),
    T.StructField("prediction", T.IntegerType()), T.StructField("failure_probability", T.DoubleType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("sensors", T.StructType([T.StructField(s, T.DoubleType()) for s in rules.SENSORS])),
    T.StructField("model", T.StringType()),
])

JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# Per-column presentation rounding of the flat prediction log.
LOG_ROUNDING = {"failure_probability": 4, "normal_probability": 4, "air_temp": 2, "process_temp": 2,
                "rotational_speed": 1, "torque": 2, "tool_wear": 1, "ensemble_agreement": 4}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, tolerant: bool = False,
             quarantine: bool = False) -> DataFrame:
    """Header CSV with a fixed schema.

    ``tolerant`` drops malformed lines (``DROPMALFORMED``); ``quarantine`` keeps
    them in ``_corrupt_record`` instead (PERMISSIVE) so they can be routed aside.
    """
    reader = spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    if quarantine:
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    elif tolerant:
        reader = reader.option("mode", "DROPMALFORMED")
    else:
        reader = reader.option("mode", "FAILFAST")
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str | None = None, name: str = "csv", mode: str = "overwrite",
              sort_by: Sequence[str] | None = None) -> str:
    """Header CSV sink (optionally globally sorted, e.g. an exported report)."""
    path = path or scratch_path(df.sparkSession, name)
    out = df.orderBy(*sort_by) if sort_by else df
    (out.write.mode(mode).option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))
    return path


def write_table(df: DataFrame, path: str | None = None, name: str = "table", buckets: int = 16,
                bucket_col: str | None = "machine_id", mode: str = "overwrite") -> str:
    """Parquet sink partitioned by a hash bucket of the machine (prunable, bounded folder count)."""
    path = path or scratch_path(df.sparkSession, name)
    if bucket_col:
        df = df.withColumn("bucket", F.pmod(F.xxhash64(bucket_col), F.lit(buckets)).cast("int"))
        df.write.mode(mode).partitionBy("bucket").parquet(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


def bucket_of(value, buckets: int = 16, dtype: str = "long"):
    """The bucket a machine id lands in (for partition-pruning filters); ``dtype``
    must be the key column's type, since the hash depends on it."""
    return F.pmod(F.xxhash64(F.lit(value).cast(dtype)), F.lit(buckets)).cast("int")


def upload_normalize(df: DataFrame, prefix: str = "MACHINE", now=None,
                     required: Sequence[str] = tuple(rules.SENSORS)) -> DataFrame:
    """Require the sensors (checked before renaming), default machine id and
    timestamp, then lower/strip every column name."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {sorted(missing)}")
    out = df
    if "machine_id" not in out.columns:
        out = out.withColumn("machine_id", F.lit(f"{prefix}_{1:03d}"))
    if "timestamp" not in out.columns:
        ts = now if now is not None else F.current_timestamp()
        out = out.withColumn("timestamp", ts if not isinstance(ts, str) else F.lit(ts).cast("timestamp_ntz"))
    return out.toDF(*[c.strip().lower() for c in out.columns])


def upload_summary(df: DataFrame) -> DataFrame:
    """S4 result: record count and the distinct machines (as a sorted list)."""
    return df.agg(F.count(F.lit(1)).alias("records"),
                  F.array_sort(F.collect_set(F.col("machine_id").cast("string"))).alias("machines"))


def prediction_log_flat(scored: DataFrame, ts_col: str = "ts") -> DataFrame:
    """The 13 log columns with the reference's per-column rounding."""
    cols = []
    for f in PREDICTION_LOG_SCHEMA.fields:
        src = ts_col if f.name == "timestamp" else f.name
        c = F.col(src)
        if f.name in LOG_ROUNDING:
            c = rules.round_half_up(c, LOG_ROUNDING[f.name])
        cols.append(c.cast(f.dataType).alias(f.name))
    return scored.select(*cols)


def prediction_log_nested(flat: DataFrame) -> DataFrame:
    """JSON-lines record shape with a nested ``sensors`` struct."""
    return flat.select("timestamp", "machine_id", "prediction", "failure_probability", "risk_level",
                       F.struct(*rules.SENSORS).alias("sensors"), F.col("model_name").alias("model"))


def write_json(df: DataFrame, path: str | None = None, name: str = "json", mode: str = "append") -> str:
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    return (spark.read.schema(schema).option("multiLine", multiline)
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path))


REGISTRY_ENTRY = T.StructType([
    T.StructField("machine_id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("installed_date", T.StringType()),
    T.StructField("next_scheduled_maintenance", T.StructType([
        T.StructField("date", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("scheduled_at", T.StringType())])),
    T.StructField("total_operating_hours", T.DoubleType()), T.StructField("total_failures", T.LongType()),
])


def registry_documents(registry: DataFrame, machines: int = 1000) -> DataFrame:
    """Encode a registry as JSON maps ``{"machine_<id>": {...}}``, one document per block of ids.

    A block is ``machines`` consecutive ids, so a document holds at most that many entries however large
    the fleet is (the reference keeps one map for the whole fleet, which would be one record in
    one task).  Machine ids are unique; entries without id share a document.
    """
    entry = F.struct(*[F.col(f.name) if f.name in registry.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in REGISTRY_ENTRY.fields])
    keyed = registry.select(F.floor(F.col("machine_id") / F.lit(machines)).alias("_block"),
                            F.format_string("machine_%d", F.col("machine_id")).alias("k"), entry.alias("v"))
    return keyed.groupBy("_block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")) \
        .select("value")


def registry_explode(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """Parse registry maps and explode them to one row per machine."""
    parsed = documents.select(F.from_json(F.col(text_col), T.MapType(T.StringType(), REGISTRY_ENTRY)).alias("m"))
    return parsed.select(F.explode("m").alias("key", "e")).select("key", "e.*")


PREDICTION_RECORD = T.StructType([
    T.StructField("prediction", T.IntegerType()), T.StructField("failure_probability", T.DoubleType()),
    T.StructField("normal_probability", T.DoubleType()), T.StructField("risk_level", T.StringType()),
    T.StructField("sensor_data", T.StructType([T.StructField(s, T.DoubleType()) for s in rules.SENSORS])),
    T.StructField("timestamp", T.TimestampNTZType()), T.StructField("seq", T.LongType()),
])


def machine_recent_predictions(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Read given JSON arrays in a folder per machine; machine id from the file path; last ``limit`` each.
    Tables that the library writes itself are by machine in few files (``machine_store``).

    Each line holds one machine's (retention-bounded) array, so its length is on
    the row: no per-machine shuffle is needed to keep the tail.
    """
    raw = spark.read.text(path).select(F.input_file_name().alias("_file"), "value")
    arr = raw.select(F.regexp_extract("_file", r"machine_id=(-?\d+)", 1).cast("long").alias("machine_id"),
                     F.from_json("value", T.ArrayType(PREDICTION_RECORD), JSON_OPTIONS).alias("a"))
    rows = arr.select("machine_id", F.size("a").alias("_n"), F.posexplode("a").alias("idx", "r"))
    return rows.filter(F.col("idx") >= F.col("_n") - limit).select("machine_id", "idx", "r.*")


def machine_report(registry: DataFrame, stats: DataFrame, scored: DataFrame, recent: int,
                   order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One report row per machine for the whole fleet in one job:
    registry entry + statistics + the newest ``recent`` predictions (bounded list)."""
    from ..operators.features import retain_last_n
    kept = retain_last_n(scored, recent, order, ["machine_id"])
    rec = F.struct(*[F.col(c) for c in order], "failure_probability", "risk_level", *rules.SENSORS)
    lists = kept.groupBy("machine_id").agg(
        F.reverse(F.array_sort(F.collect_list(rec))).alias("recent_predictions"))
    out = registry.join(stats, "machine_id", "left").join(lists, "machine_id", "left")
    return out.withColumn("report", F.to_json(F.struct(*[F.col(c) for c in out.columns if c != "machine_id"])))
