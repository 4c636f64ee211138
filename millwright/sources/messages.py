"""Message-shaped sources (S5-S8): topic messages, fleet documents, live readings.

The same parsing functions serve batch reads of landed files and
``readStream`` sources (see ``millwright.streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules

READING_SCHEMA = T.StructType([T.StructField(s, T.DoubleType()) for s in rules.SENSORS])
TOPIC_SCHEMA = T.StructType([T.StructField("topic", T.StringType()), T.StructField("payload", T.StringType()),
                             T.StructField("arrival", T.TimestampNTZType())])
FLEET_ENTRY = T.StructType([T.StructField("machine_id", T.StringType()),
                            *[T.StructField(s, T.DoubleType()) for s in rules.SENSORS]])
FLEET_SCHEMA = T.StructType([T.StructField("machines", T.ArrayType(FLEET_ENTRY)),
                             T.StructField("fetched_at", T.TimestampNTZType())])
LIVE_SCHEMA = T.StructType([
    T.StructField("machine_id", T.StringType()), *[T.StructField(s, T.DoubleType()) for s in rules.SENSORS],
    T.StructField("source", T.StringType()), T.StructField("metadata", T.StringType()),
    T.StructField("received_at", T.TimestampNTZType())])


def topic_message_parse(messages: DataFrame, topic_col: str = "topic", payload_col: str = "payload",
                        arrival_col: str | None = "arrival") -> DataFrame:
    """S5: 'factory/machines/<id>/sensors' -> machine id (segment 2), JSON payload -> columns.

    Topics with fewer than three segments and payloads that are no JSON object are left out; see
    ``topic_message_rejects``.
    """
    parts = F.split(F.col(topic_col), "/")
    parsed = messages.filter(_readable(topic_col, payload_col)).select(
        parts.getItem(2).alias("machine_id"),
        F.from_json(F.col(payload_col), READING_SCHEMA).alias("r"),
        *([F.col(arrival_col).alias("timestamp")] if arrival_col and arrival_col in messages.columns else []))
    return parsed.select("machine_id", *[F.col(f"r.{s}").alias(s) for s in rules.SENSORS],
                         *(["timestamp"] if "timestamp" in parsed.columns else []))


def _readable(topic_col: str, payload_col: str):
    text = F.get_json_object(F.col(payload_col), "$")
    return F.coalesce((F.size(F.split(F.col(topic_col), "/")) >= 3) & text.isNotNull() & F.trim(text).startswith("{"), F.lit(False))


def topic_message_rejects(messages: DataFrame, topic_col: str = "topic", payload_col: str = "payload") -> DataFrame:
    """S5, the quarantine output: messages that ``topic_message_parse`` leaves out, with the reason."""
    reason = F.when(F.size(F.split(F.col(topic_col), "/")) >= 3, F.lit("payload")).otherwise(F.lit("topic"))
    return messages.filter(~_readable(topic_col, payload_col)).withColumn("reason", reason)


def fleet_doc_explode(docs: DataFrame, ingest_col: str = "fetched_at") -> DataFrame:
    """One row per machine element of ``{machines: [...]}`` documents."""
    cols = [F.explode("machines").alias("m")]
    if ingest_col in docs.columns:
        cols.append(F.col(ingest_col).alias("timestamp"))
    out = docs.select(*cols)
    return out.select("m.*", *(["timestamp"] if ingest_col in docs.columns else []))


def live_ingest(readings: DataFrame, default_source: str = "api") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Blank machine ids are rejected; sensors default
    to 0; source defaults to ``api``; metadata is kept as JSON text."""
    valid = F.col("machine_id").isNotNull() & (F.trim(F.col("machine_id")) != "")
    accepted = readings.filter(valid).select(
        F.trim("machine_id").alias("machine_id"),
        *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in rules.SENSORS],
        F.coalesce(F.col("source"), F.lit(default_source)).alias("source"),
        F.col("metadata"),
        *([F.col("received_at")] if "received_at" in readings.columns else []))
    rejected = readings.filter(~valid)
    return accepted, rejected


def latest_reading(readings: DataFrame, order=("ts", "event_id"), key: str = "machine_id") -> DataFrame:
    """Newest reading per machine (max_by aggregation: map-side combine, skew-safe)."""
    others = [c for c in readings.columns if c != key]
    agg = readings.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return agg.select(key, *[F.col(f"r.{c}").alias(c) for c in others])
