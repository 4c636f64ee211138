"""Views of logs: marks, null times, ties, clashing columns."""
import datetime as dt

from pyspark.sql import functions as F

from millwright.functions import rules
from millwright.operators import logs

T0 = dt.datetime(2024, 1, 1)


def _failures(spark, rows):
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, machine_id long, prediction int, resolved int")
    return df.select("*", F.lit("HIGH").alias("risk_level"), F.lit(0.6).alias("failure_probability"), *[F.lit(1.0).alias(s) for s in rules.SENSORS])


def test_newest_and_unresolved(spark):
    later = T0 + dt.timedelta(hours=1)
    df = _failures(spark, [(1, T0, 1, 1, 0), (2, later, 1, 1, 0), (3, later, 1, 1, 0), (4, later, 1, 1, 1), (5, None, 2, 1, 0), (6, T0, 2, 1, 0),
                           (7, T0, 3, 1, None), (8, T0, 4, 0, 0), (9, T0, None, 1, 0)])
    assert sorted(r["id"] for r in logs.unresolved_failures(df).collect()) == [1, 2, 3, 5, 6, 9]
    assert {r["machine_id"]: r["id"] for r in logs.newest_failure_per_machine(df).collect()} == {1: 3, 2: 6, None: 9}
    assert logs.newest_failure_per_machine(df.limit(0)).count() == 0
    log = df.withColumnsRenamed({"timestamp": "ts", "id": "event_id"})
    assert {r["machine_id"]: r["event_id"] for r in logs.oldest_failure_per_machine(log).collect()} == {1: 1, 2: 5, 3: 7, None: 9}
    assert logs.failures_of_log(log).count() == 7 and logs.failures_of_log(log.drop("resolved")).count() == 8


def test_levels_and_machines(spark):
    df = spark.createDataFrame([(1, "LOW"), (2, "HIGH"), (2, None)], "machine_id long, risk_level string")
    assert logs.of_risk(df, "LOW", "HIGH").count() == 2 and logs.of_machine(df, 2).count() == 2 and logs.of_machine(df, 9).count() == 0


def test_positions_give_times_and_machines(spark):
    df = spark.createDataFrame([(k, "old") for k in (5, 3, 9, 7)], "k long, timestamp string")
    made = {r["k"]: r["timestamp"] for r in logs.with_synthetic_time(df, ["k"], step_minutes=5).collect()}
    assert made == {k: T0 + dt.timedelta(minutes=5 * i) for i, k in enumerate((3, 5, 7, 9))}
    rows = {r["k"]: (r["machine_id"], r["row_id"]) for r in logs.with_machines(df.withColumn("row_id", F.lit("x")), ["k"], machines=3).collect()}
    assert rows == {3: (1, "MACHINE_0001"), 5: (2, "MACHINE_0002"), 7: (3, "MACHINE_0003"), 9: (1, "MACHINE_0004")}
    assert logs.with_machines(df.limit(0), ["k"]).count() == 0


def test_first_of_each_class_in_the_later_part(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i), int(i in (0, 18))) for i in range(20)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, machine_failure int")
    got = {r["machine_failure"]: r["event_id"] for r in logs.sample_per_class(df, ["event_id"]).collect()}
    assert got == {0: 16, 1: 18}
