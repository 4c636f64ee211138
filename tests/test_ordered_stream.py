"""Event-time order, bounded state, replays and the live path of the streams."""
import math

from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.operators import features
from millwright.operators.bucketed import BucketedTable
from millwright.session import scratch_path
from millwright.streaming import live, ordered

NAMES = ["air_temp_mean_6", "process_temp_mean_6", "rpm_std_6", "torque_std_6", "air_temp_lag1", "air_temp_lag2",
         "rpm_ema", "temp_diff", "wear_torque"]


def run_slices(spark, slices, build, name="ordered"):
    """Land each slice, then run the stream until nothing is left; the checkpoint carries on."""
    run = live.StreamRun(spark, name)
    for part in slices:
        run.land(part)
        run.run(build(run, run.source(slices[0].schema)))
    return run


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7))


def shuffled_slices(df, hours=24, n=3):
    """Rows of ``df`` in ``n`` arrivals, each row up to ``hours`` late."""
    arrival = F.timestamp_add("SECOND", F.pmod(F.xxhash64("event_id"), F.lit(hours * 3600)).cast("int"), F.col("ts"))
    return [s.drop("arrival") for s in live.time_slices(df.withColumn("arrival", arrival), n, "arrival")]


def test_late_rows_and_repeats_change_nothing_against_batch(spark):
    s = fx.sensors(spark, SF_SMALL).withColumn("torque", F.when(F.pmod("event_id", F.lit(7)) > 0, F.col("torque")))
    slices = shuffled_slices(s)
    slices[1] = slices[1].unionByName(slices[0].filter(F.pmod("event_id", F.lit(3)) == 0))     # delivered again
    run = run_slices(spark, slices, lambda r, src: ordered.ordered_features(src, "24 hours", "60 days").writeStream
                     .outputMode("append").format("parquet").option("path", r.sink))
    got = {r["event_id"]: r for r in spark.read.parquet(run.sink).collect()}
    assert len(got) == spark.read.parquet(run.sink).count()
    batch = features.feature_pipeline(s, mode="native", fill=False)
    edge = s.agg(F.max("ts") - F.expr("interval 24 hours")).first()[0]
    want = {r["event_id"]: r for r in batch.filter(F.col("ts") < F.lit(edge)).collect()}
    assert len(want) > 900 and set(got) == set(want)
    for i, row in want.items():
        assert all(close(got[i][c], row[c]) for c in NAMES), (got[i], row)


def test_idle_machines_start_anew_and_late_rows_stay_out(spark):
    def rows(*cells):
        df = spark.createDataFrame([(i, m, t, float(i)) for i, m, t in cells], "event_id long, machine_id long, t string, air_temp double")
        return df.select("event_id", "machine_id", F.col("t").cast("timestamp_ntz").alias("ts"), "air_temp")
    slices = [rows((1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:10:00"), (9, 2, "2024-01-01 12:00:00")),
              rows((3, 1, "2024-01-01 00:05:00"), (4, 1, "2024-01-01 13:00:00"), (10, 2, "2024-01-02 12:00:00")),
              rows((11, 2, "2024-01-03 12:00:00"), (5, 1, "2024-01-02 13:00:00"))]
    run = run_slices(spark, slices, lambda r, src: ordered.ordered_features(src, "1 hour", "2 hours").writeStream
                     .outputMode("append").format("parquet").option("path", r.sink))
    got = {r["event_id"]: r["air_temp_lag1"] for r in spark.read.parquet(run.sink).collect()}
    # 3 came after the watermark (11:00) had passed it; 4 comes after the idle state of machine 1 has gone
    assert got == {1: None, 2: 1.0, 4: None, 5: None, 9: None, 10: None}


def test_empty_stream_and_rows_without_keys(spark):
    s = fx.sensors(spark, SF_SMALL)
    bad = s.limit(5).withColumn("machine_id", F.lit(None).cast("long"))
    for part in (s.limit(0), bad):
        run = run_slices(spark, [part], lambda r, src: ordered.ordered_features(src).writeStream
                         .outputMode("append").format("parquet").option("path", r.sink))
        assert spark.read.schema(s.schema).parquet(run.sink).isEmpty()


def test_latest_of_a_unit_leaves_once(spark):
    mf = fx.machine_failures(spark, SF_SMALL).select("id", "timestamp", "machine_id", "risk_level")
    slices = live.time_slices(mf, 3, "timestamp")
    slices[1] = slices[1].unionByName(slices[0].filter(F.pmod("id", F.lit(2)) == 0))
    run = run_slices(spark, slices, lambda r, src: ordered.latest_per_unit(src, "1 day", "24 hours").writeStream
                     .outputMode("append").format("parquet").option("path", r.sink))
    edge = mf.agg(F.max("timestamp") - F.expr("interval 24 hours")).first()[0]
    day = F.date_trunc("day", F.col("timestamp"))
    want = (mf.filter(F.timestamp_add("DAY", F.lit(1), day) <= F.lit(edge)).groupBy(day, "machine_id")
            .agg(F.max("id").alias("id")).select("id"))
    assert sorted(r["id"] for r in spark.read.parquet(run.sink).collect()) == sorted(r["id"] for r in want.collect())


def test_windows_of_machines_replace_themselves(spark):
    s = fx.sensors(spark, SF_SMALL).select("event_id", "machine_id", "ts", "torque")
    slices = shuffled_slices(s)
    slices[2] = slices[2].unionByName(slices[0])             # delivered again
    table = BucketedTable(spark, scratch_path(spark, "last"), ["machine_id"], 8)
    run_slices(spark, slices, lambda r, src: ordered.last_n(src, 4, "40 days", "60 days").writeStream.outputMode("update")
               .foreachBatch(ordered.window_writer(table, f"{r.sink}-staging")))
    want = features.retain_last_n(s, 4)
    assert sorted(r["event_id"] for r in table.read().collect()) == sorted(r["event_id"] for r in want.collect())


def test_machines_of_a_group_share_a_state(spark):
    """Two states for 60 machines, with a gap that starts some of them anew, give what batch features give."""
    rows = [(i, i % 60, f"2024-01-{1 + i // 60 + (9 if i % 60 < 20 and i >= 300 else 0):02d} {i % 24:02d}:00:00", float(i * 7 % 50)) for i in range(600)]
    s = spark.createDataFrame(rows, "event_id long, machine_id long, t string, air_temp double").select(
        "event_id", "machine_id", F.col("t").cast("timestamp_ntz").alias("ts"), "air_temp")
    run = live.StreamRun(spark, "groups")
    for part in (s.filter("event_id < 300"), s.filter("event_id >= 300")):
        run.land(part)
        query = ordered.ordered_features(run.source(s.schema), "1 hour", "5 days", groups=2).writeStream.outputMode("append") \
            .format("parquet").option("path", run.sink).option("checkpointLocation", run.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None and max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) == 2
    parted = s.withColumn("run", F.when(F.expr("machine_id < 20 and event_id >= 300"), 1).otherwise(0))
    want = {r["event_id"]: r for r in features.feature_pipeline(parted, partition_by=["machine_id", "run"], mode="native", fill=False).collect()}
    got = spark.read.parquet(run.sink).collect()
    assert len(got) > 550 and len({r["event_id"] for r in got}) == len(got)
    for r in got:
        assert all(close(r[c], want[r["event_id"]][c]) for c in ("air_temp_mean_6", "air_temp_lag1", "air_temp_lag2")), r


def test_live_path_scores_logs_registers_and_rejects(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    from millwright.suite import live_q
    columns = features.MODEL_FEATURES
    s = fx.sensors(spark, SF_SMALL)
    train = live_q.history(s)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"),
                             NaiveBayes(modelType="gaussian", labelCol="machine_failure")]).fit(train)
    tables = live_q.run_live(spark, s, model)
    log, registry, rejects = tables.log(), tables.registry.read(), tables.rejects()
    edge = s.agg(F.max("ts") - F.expr(f"interval {live_q.DELAY}")).first()[0]
    due = s.filter(F.col("ts") < F.lit(edge))
    assert log.count() == due.count() == log.select("event_id").distinct().count()
    seen = {r["machine_id"]: (r["created_timestamp"], r["last_seen"]) for r in registry.collect()}
    want = due.groupBy("machine_id").agg(F.min("ts"), F.max("ts")).collect()
    assert seen == {str(r[0]): (r[1], r[2]) for r in want}
    assert {r["reason"] for r in rejects.collect()} == {"machine", "time"}
    # a replay of the last batch leaves log and registry as they are
    number, before = log.agg(F.max("batch")).first()[0], log.count()
    scores = ("prediction", "failure_probability", "normal_probability", "risk_level", "maintenance_required")
    staged = scratch_path(spark, "replay")
    spark.read.parquet(f"{tables.log_root}/batch={number}").drop(*scores).write.parquet(staged)
    ordered.live_writer(model, columns, tables.log_root, tables.registry)(spark.read.parquet(staged), number)
    assert tables.log().count() == before and spark.read.parquet(staged).count() > 0
    assert {r["machine_id"]: (r["created_timestamp"], r["last_seen"]) for r in tables.registry.read().collect()} == seen
