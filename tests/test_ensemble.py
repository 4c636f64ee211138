"""Ensembles of fitted models: scaling, choice, saving, votes, the live path; the full evaluation text."""
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.operators import metrics
from millwright.operators.bucketed import BucketedTable
from millwright.plans import boosting, ensemble, training
from millwright.plans.boosting import Settings
from millwright.session import scratch_path
from millwright.streaming import ordered

COLUMNS = ["torque", "tool_wear", "air_temp", "rotational_speed"]


def _members(train, columns):
    lr = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"),
                          LogisticRegression(labelCol=training.LABEL, maxIter=50)]).fit(train)
    return {"lr": lr, "trees": boosting.fit_boosted(train, columns, [Settings(rounds=10, max_depth=3)])[0]}


@pytest.fixture(scope="module")
def fitted(spark):
    train, test = training.time_split(fx.sensors(spark, SF_SMALL))
    return ensemble.train_ensemble(train, test, COLUMNS, _members), test


def test_scaler_is_the_training_parts(spark, fitted):
    train, _ = training.time_split(fx.sensors(spark, SF_SMALL))
    t = train.toPandas()
    for c in COLUMNS:
        mean, deviation = fitted[0].scaler[c]
        assert mean == pytest.approx(t[c].mean()) and deviation == pytest.approx(t[c].std(ddof=0))


def test_missing_and_null_features_count_as_zero_before_scaling(spark):
    df = spark.createDataFrame([(1, None, "kept")], "id int, a double, prediction string")
    row = ensemble.scaled(df, ["a", "b"], {"a": (2.0, 4.0), "b": (1.0, 1.0)}).first().asDict()
    assert row == {"id": 1, "a": -0.5, "b": -1.0}
    empty = ensemble.fitted_scaler(df.limit(0), ["a"])
    assert empty == {"a": (0.0, 1.0)}


def test_best_has_the_highest_area_and_ties_go_to_the_earlier(spark, fitted):
    e, test = fitted
    assert e.best == max(e.scores, key=lambda s: (s["pr_auc"], -s["rank"]))["model"]
    voted = ensemble.votes(test, e)
    for s in e.scores:
        assert metrics.pr_summary(voted, score=f"p_{s['model']}").first()["pr_auc"] == s["pr_auc"]
    train, rest = training.time_split(fx.sensors(spark, SF_SMALL))
    lr = e.models["lr"]
    twice = ensemble.train_ensemble(train, rest, COLUMNS, lambda t, c: {"second": lr, "first": lr})
    assert twice.best == "second"


def test_votes_agree_with_the_models_and_survive_saving(spark, fitted):
    e, test = fitted
    again = ensemble.load(spark, ensemble.save(spark, e, scratch_path(spark, "ensemble-test")))
    assert (again.best, again.scores, again.scaler, again.feature_columns) == (e.best, e.scores, e.scaler, e.feature_columns)
    assert list(again.models) == list(e.models)
    a, b = ensemble.votes(test, e), ensemble.votes(test, again)
    assert a.columns == b.columns and a.exceptAll(b).count() == 0 and a.count() == test.count()
    for r in a.collect():
        assert r["vote_trees"] == int(r["p_trees"] >= 0.5) or abs(r["p_trees"] - 0.5) < 1e-6
        assert r["failure_probability"] == r[f"p_{e.best}"] and r["prediction"] == r[f"vote_{e.best}"]
        assert r["ensemble_agreement"] == (1.0 if r["vote_lr"] == r["vote_trees"] else 0.5)
    assert ensemble.votes(test.limit(0), e).count() == 0


def test_the_live_writer_logs_votes_once(spark, fitted):
    e, test = fitted
    root = scratch_path(spark, "live-votes")
    registry = BucketedTable(spark, f"{root}/registry", ["machine_id"], 4)
    write = ordered.live_writer(e, e.feature_columns, f"{root}/log", registry)
    batch = test.withColumn("machine_id", F.col("machine_id").cast("string"))
    for _ in range(2):
        write(batch, 0)
    log = spark.read.parquet(f"{root}/log")
    assert log.count() == test.count() and {"vote_lr", "vote_trees", "ensemble_agreement", "model_name"} <= set(log.columns)
    assert registry.read().count() == test.select("machine_id").distinct().count()


def _share(a, b):
    return a / b if b else 0.0


def test_evaluation_text_by_hand(spark):
    rows = [(0, 0, 0.1)] * 6 + [(0, 1, 0.7)] * 2 + [(1, 0, 0.4)] + [(1, 1, 0.9)] * 3
    df = spark.createDataFrame(rows, "machine_failure int, prediction int, failure_probability double")
    lines = metrics.evaluation_text(df, "x").first()["report"].split("\n")
    assert lines[:8] == ["=" * 60, "Model Evaluation Report", "=" * 60, "", "Model: x", "", "--- Primary Metrics ---",
                         "Precision:           0.6000"]
    at = lines.index("--- Classification Report ---")
    assert lines[at + 1:at + 10] == [
        "              precision    recall  f1-score   support", "",
        "      Normal       0.86      0.75      0.80         8",
        "     Failure       0.60      0.75      0.67         4", "",
        "    accuracy                           0.75        12",
        "   macro avg       0.73      0.75      0.73        12",
        "weighted avg       0.77      0.75      0.76        12", ""]
    assert lines[-3:] == ["               Predicted Normal  Predicted Failure",
                          "Actual Normal             6                2", "Actual Failure            1                3"]


def test_evaluation_text_without_rows(spark):
    df = spark.createDataFrame([], "machine_failure int, prediction int, failure_probability double")
    text = metrics.evaluation_text(df, "x").first()["report"]
    assert "Precision:           0.0000" in text and "Actual Failure            0                0" in text
