from pyspark.sql import functions as F

from paths import SF_SMALL
from millwright.functions import rules
from millwright.suite import streaming_q


def test_risk_band_boundaries(spark):
    df = spark.createDataFrame([(0.8,), (0.7999,), (0.5,), (0.3,), (0.2999,)], "p double")
    got = [r[0] for r in df.select(rules.risk_band("p")).collect()]
    assert got == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW"]


def test_parts_and_action(spark):
    df = spark.createDataFrame([(0.75, "CRITICAL"), (0.1, "WHATEVER")], "m double, lvl string")
    r = df.select(rules.parts_list("m").alias("p"), rules.action_for_level("lvl").alias("a")).collect()
    assert len(r[0]["p"]) == 8 and r[1]["p"] == ["General Inspection Kit"]
    assert r[1]["a"] == "Monitor machine"


def test_round_half_up_matches_python(spark):
    df = spark.createDataFrame([(0.01045,), (2.675,), (0.123456,)], "x double")
    got = [r[0] for r in df.select(rules.round_half_up("x", 4)).collect()]
    assert got == [round(0.01045, 4), round(2.675, 4), round(0.123456, 4)]


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    out = streaming_q.q_stream_buffer_append(spark, SF_SMALL)
    assert out.count() == out.select("event_id").distinct().count() == 1000
