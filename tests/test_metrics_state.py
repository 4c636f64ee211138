import pytest
from pyspark.sql import functions as F

from paths import SF_MID
from millwright import fixtures as fx
from millwright.operators import metrics, state


def test_golden_confusion_gives_published_metrics(spark):
    cm = spark.createDataFrame([(1956, 5, 12, 27)], "tn long, fp long, fn long, tp long")
    r = metrics.metrics_from_confusion(cm).first()
    assert round(r["precision"], 4) == 0.8438
    assert round(r["recall"], 4) == 0.6923
    assert round(r["f1"], 4) == 0.7606


def test_pr_auc_and_ap_of_fixture(spark):
    s = metrics.pr_summary(fx.predictions(spark, SF_MID)).first()
    assert s["pr_auc"] == pytest.approx(0.182735, abs=1e-6)
    assert s["average_precision"] == pytest.approx(0.183921, abs=1e-6)


def test_all_tied_scores_and_empty_positives(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)], "machine_failure int, failure_probability double")
    s = metrics.pr_summary(df).first()
    # one point (recall 1, precision .5) after (0, 1): trapezoid = .75, AP = .5
    assert s["pr_auc"] == pytest.approx(0.75)
    assert s["average_precision"] == pytest.approx(0.5)
    neg = spark.createDataFrame([(0, 1), (0, 0)], "machine_failure int, prediction int")
    r = metrics.classification_metrics(neg).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0


def test_upsert_is_idempotent(spark):
    mf = fx.machine_failures(spark, "/root/testdata/sf0.001")
    once = state.upsert_predictions(mf, mf, key_unit="day")
    twice = state.upsert_predictions(once, mf, key_unit="day")
    assert sorted(once.select("id").toPandas()["id"]) == sorted(twice.select("id").toPandas()["id"])


def test_purge_keeps_null_times(spark):
    df = spark.createDataFrame(
        [(1, 1, None), (2, 1, "2024-01-01 00:00:00"), (3, 0, "2024-01-01 00:00:00"), (4, 1, "2024-03-01 00:00:00")],
        "id int, resolved int, t string").withColumn("resolved_timestamp", F.col("t").cast("timestamp_ntz"))
    out = state.purge_resolved(df, "2024-03-02 00:00:00", 7)
    assert sorted(r["id"] for r in out.collect()) == [1, 3, 4]
