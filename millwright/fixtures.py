"""Views derived from the shared test tables (see FIXTURES.md, part B).

Every view is a lazy DataFrame over the parquet tables, so its work grows
with them; nothing is made up on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .plans import scoring

SENSORS = rules.SENSORS
FAILURE_TYPES = ["TWF", "HDF", "PWF", "OSF", "RNF"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings view over ``events``."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        F.col("user_id").alias("machine_id"),
        "ts",
        (F.lit(295.0) + k / F.lit(10.0)).alias("air_temp"),
        (F.lit(305.0) + F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(100)) / F.lit(10.0)).alias("process_temp"),
        (F.lit(1200.0) + F.pmod(F.col("event_id") * 31 + F.col("user_id") * 17, F.lit(1600))).alias("rotational_speed"),
        F.least(F.col("value"), F.lit(80.0)).alias("torque"),
        F.pmod(F.col("event_id"), F.lit(250)).cast("double").alias("tool_wear"),
        F.when(F.pmod(F.col("user_id"), F.lit(3)) == 0, "L")
         .when(F.pmod(F.col("user_id"), F.lit(3)) == 1, "M").otherwise("H").alias("type"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 50) & (F.pmod(F.col("event_id"), F.lit(250)) >= 125), 1)
         .otherwise(0).alias("machine_failure"),
    )


def sensors_with_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors plus the five failure-type flags and the one-hot type columns."""
    s = sensors(spark, sf_dir)
    flags = [F.when((F.col("machine_failure") == 1) & (F.pmod(F.col("event_id"), F.lit(5)) == i), 1)
             .otherwise(0).alias(name) for i, name in enumerate(FAILURE_TYPES)]
    return s.select("*", *flags)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors + linear scores and votes (the prediction history)."""
    return scoring.score_linear(sensors(spark, sf_dir))


def machine_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "machine_id", "prediction",
        "failure_probability", "normal_probability", "risk_level", *SENSORS, "model_name",
        "ensemble_agreement", F.lit(0).alias("resolved"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_timestamp"),
        F.lit(None).cast("string").alias("resolved_by"), F.lit(None).cast("string").alias("notes"))


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third machine is resolved by 'team' at its last reading time."""
    s = sensors(spark, sf_dir).filter(F.pmod(F.col("machine_id"), F.lit(3)) == 0)
    return (s.groupBy("machine_id")
            .agg(F.max("ts").alias("resolved_timestamp"))
            .select("machine_id", "resolved_timestamp", F.lit("team").alias("resolved_by"),
                    F.lit("resolved in fixture").alias("notes")))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine registry: first/last reading, location and type from the index rule."""
    s = sensors(spark, sf_dir)
    agg = s.groupBy("machine_id").agg(F.min("ts").alias("created_timestamp"), F.max("ts").alias("last_seen"))
    return agg.select(
        "machine_id", "created_timestamp", "last_seen", F.lit("OPERATIONAL").alias("status"),
        rules.fleet_location("machine_id").alias("location"), rules.fleet_type("machine_id").alias("type"))


def with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sensors(spark, sf_dir)
    return s.withColumn("air_temp", F.when(F.pmod(F.col("event_id"), F.lit(11)) == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("air_temp")))


def bad_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sensors(spark, sf_dir)
    return s.withColumn("torque", F.when(F.pmod(F.col("event_id"), F.lit(13)) == 0, F.lit("n/a"))
                        .otherwise(F.col("torque").cast("string")))


def raw_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sensors(spark, sf_dir)
    return s.unionByName(s.filter(F.pmod(F.col("event_id"), F.lit(10)) == 0))
