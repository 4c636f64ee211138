import pytest

from paths import SF_SMALL
from millwright import fixtures as fx
from millwright.operators import reports
from millwright.suite import quality_q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_stay_jvm_side(spark):
    scored = fx.predictions(spark, SF_SMALL)
    for df in (reports.machines_at_risk(scored), reports.maintenance_schedule(scored),
               reports.sensor_anomalies(fx.sensors(spark, SF_SMALL)), reports.machines_summary(scored)):
        plan = _plan(df)
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_filter_and_projection_reach_the_scan(spark):
    plan = _plan(quality_q.q_filter_by_machine(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan
    narrow = _plan(fx.sensors(spark, SF_SMALL).select("event_id", "machine_id").filter("machine_id = 7"))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in narrow


def test_newest_per_machine_is_an_aggregate_not_a_window(spark):
    plan = _plan(reports.machines_at_risk(fx.predictions(spark, SF_SMALL)))
    assert "HashAggregate" in plan or "ObjectHashAggregate" in plan or "SortAggregate" in plan
    assert "Window" not in plan


def test_registered_boosted_queries_run_the_librarys_settings(monkeypatch):
    from millwright.plans import boosting, training
    from millwright.suite import models_q

    class Fitted(Exception):
        pass

    fits, trials = [], []

    def fit(train, features, settings, **k):
        fits.extend(settings)
        raise Fitted

    monkeypatch.setattr(boosting, "fit_boosted", fit)
    monkeypatch.setattr(training, "pos_weight", lambda df: 1.0)
    monkeypatch.setattr(training, "tune", lambda train, valid, columns, n_trials=50, space=None: trials.append((n_trials, space)))
    monkeypatch.setattr(models_q, "_split", lambda spark, d: (None, type("T", (), {"agg": lambda *a: None})()))
    for query in (models_q.q_train_gbt, models_q.q_train_gbt_b, models_q.q_model_roundtrip, models_q.q_tree_attribution):
        with pytest.raises(Fitted):
            query(None, "")
    with pytest.raises(AttributeError):
        models_q.q_tune_search(None, "")
    assert fits == [training.GBT_A, training.GBT_B, training.GBT_A, training.GBT_A]
    assert (training.GBT_A.rounds, training.GBT_A.max_depth, training.GBT_B.max_leaves) == (200, 6, 31)
    assert trials == [(50, None)]
