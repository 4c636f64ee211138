import re

import __spark_entry__ as E
from paths import SF_SMALL
from oracle import duck, matches


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["machine_id", "risk_level", "average_risk_score"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len([k for k in q if not re.match(r"op\d+_|pipeline$", k)]) >= 120


FAST = ["machines_at_risk_scored", "factory_health", "maintenance_schedule", "prediction_stats", "risk_band",
        "parts_list", "time_split", "row_position", "rolling_global", "lag_features", "fill_global",
        "confusion_matrix", "pr_auc", "average_precision", "upsert_predictions", "resolve_failures",
        "null_profile", "coerce_types", "latest_reading", "linear_attribution", "top3_attribution"]


def test_oracle_subset_small(spark):
    q, o = E.queries(), E.oracle_sql()
    con = duck(SF_SMALL)
    for k in FAST:
        matches(q[k](spark, SF_SMALL), con, o[k])
