import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwright.operators import features as feat
from millwright.operators import ordering


def _frame(spark, n=300, groups=4, null_every=7, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, groups, n)
    g[: n // 3] = 0  # a hot group holding a third of all rows
    pdf = pd.DataFrame({"event_id": np.arange(n), "machine_id": g, "ts": np.arange(n) * 10,
                        "x": rng.normal(50, 10, n)})
    pdf.loc[pdf.event_id % null_every == 0, "x"] = np.nan
    pdf.loc[:3, "x"] = np.nan  # leading nulls: back-fill must reach across chunks
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("chunks", [1, 3, 16, 120])
def test_row_position_matches_numbering(spark, chunks):
    pdf, df = _frame(spark)
    out = ordering.row_position(df, ["ts", "event_id"], name="p", num_chunks=chunks).toPandas()
    assert (out.sort_values("event_id")["p"].to_numpy() == np.arange(len(pdf))).all()
    grp = ordering.row_position(df, ["ts", "event_id"], ["machine_id"], name="gp", num_chunks=chunks,
                                size_name="gn").toPandas().sort_values("event_id")
    exp = pdf.sort_values("event_id").groupby("machine_id").cumcount().to_numpy()
    assert (grp["gp"].to_numpy() == exp).all()
    sizes = pdf.groupby("machine_id").size()
    assert (grp["gn"].to_numpy() == sizes.loc[grp["machine_id"]].to_numpy()).all()


@pytest.mark.parametrize("chunks", [1, 7, 150])
def test_global_rolling_and_lag_match_pandas(spark, chunks):
    pdf, df = _frame(spark)
    out = feat.rolling(df, {"x": (("mean", "std"), "x")}, windows=(6,), partition_by=None, num_chunks=chunks)
    out = feat.lags(out, {"x": ((1, 2), "x")}, partition_by=None, num_chunks=chunks).toPandas().sort_values("event_id")
    s = pdf.sort_values("event_id")["x"]
    np.testing.assert_allclose(out["x_mean_6"], s.rolling(6, min_periods=1).mean(), rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(out["x_std_6"], s.rolling(6, min_periods=1).std(), rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(out["x_lag2"], s.shift(2), equal_nan=True)


@pytest.mark.parametrize("chunks", [1, 5, 200])
def test_ewm_matches_pandas(spark, chunks):
    pdf, df = _frame(spark)
    out = feat.ewm_mean(df.fillna(0.0), {"x": (6, "x_ema")}, partition_by=None, num_chunks=chunks)
    got = out.toPandas().sort_values("event_id")["x_ema"].to_numpy()
    exp = pdf.fillna(0.0).sort_values("event_id")["x"].ewm(span=6, adjust=True).mean().to_numpy()
    np.testing.assert_allclose(got, exp, rtol=1e-12)


@pytest.mark.parametrize("chunks", [1, 9, 100])
@pytest.mark.parametrize("grouped", [False, True])
def test_fill_back_then_forward(spark, chunks, grouped):
    pdf, df = _frame(spark)
    part = ["machine_id"] if grouped else None
    out = feat.fill_nulls(df, ["x"], partition_by=part, num_chunks=chunks, drop_remaining=False)
    got = out.toPandas().sort_values("event_id")["x"].to_numpy()
    p = pdf.sort_values("event_id")
    if grouped:
        exp = p.groupby("machine_id")["x"].transform(lambda s: s.bfill().ffill()).to_numpy()
    else:
        exp = p["x"].bfill().ffill().to_numpy()
    np.testing.assert_allclose(got, exp)


def test_feature_plan_has_no_single_partition_window(spark):
    _, df = _frame(spark)
    out = feat.rolling(df, {"x": (("mean",), "x")}, partition_by=["machine_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_chunk" in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:                 # only the chunk table, one row per chunk
            assert "keys=[_chunk#" in lines[i + 1], plan


def test_native_mode_agrees_with_chunked(spark):
    _, df = _frame(spark)
    a = feat.rolling(df, {"x": (("mean",), "x")}, mode="native").orderBy("event_id").toPandas()
    b = feat.rolling(df, {"x": (("mean",), "x")}, mode="chunked", num_chunks=11).orderBy("event_id").toPandas()
    np.testing.assert_allclose(a["x_mean_6"], b["x_mean_6"], equal_nan=True)


def test_feature_pipeline_splits_only_hot_machines(spark):
    pdf, _ = _frame(spark)
    pdf["air_temp"] = pdf["torque"] = pdf["process_temp"] = pdf["rotational_speed"] = pdf["x"]
    pdf["tool_wear"] = 1.0
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    frames = [feat.feature_pipeline(df, mode=m, hot_rows=h).orderBy("event_id").toPandas() for m, h in (("native", 1), ("chunked", 1), ("auto", 90), ("auto", 10**9))]
    for f in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], f[frames[0].columns], rtol=1e-9)


@pytest.mark.parametrize("rows", [0, 1, 2, 301])
def test_half_without_a_sort_matches_positions(spark, rows, monkeypatch):
    monkeypatch.setattr(ordering, "MIDDLE_ROWS", 5)
    monkeypatch.setattr(ordering, "MIDDLE_BINS", 7)
    df = spark.range(rows).select(F.col("id").alias("event_id"), (F.col("id") / 9).cast("int").alias("ts"))
    got = {r["event_id"]: r["half"] for r in ordering.with_half(df, ["ts", "event_id"]).collect()}
    assert got == {i: int(i >= rows // 2) for i in range(rows)}


def test_time_split_cut(spark):
    _, df = _frame(spark, n=101)
    out = ordering.time_split(df, ["ts", "event_id"], 0.2)
    assert out.filter(F.col("split") == "train").count() == int(101 * 0.8)


@pytest.mark.parametrize("middle_rows", [0, 7, 100_000])
def test_halves_with_null_keys_do_not_depend_on_the_size(spark, monkeypatch, middle_rows):
    monkeypatch.setattr(ordering, "MIDDLE_ROWS", middle_rows)
    df = spark.range(501).selectExpr("id AS event_id", "if(id % 10 = 0, null, timestamp_seconds((id * 7919) % 501)) AS ts",
                                     "case when id % 9 = 0 then double('NaN') when id % 9 = 1 then double('-Infinity') when id % 9 = 2 then null else id / 3 end AS x")
    for keys in (["ts", "event_id"], ["x", "event_id"]):
        expected = {r["event_id"]: int(i >= 250) for i, r in enumerate(df.orderBy(*keys).collect())}
        assert {r["event_id"]: r["half"] for r in ordering.with_half(df, keys).collect()} == expected
    same = df.selectExpr("event_id", "1 AS k")
    assert {r["half"] for r in ordering.with_half(same, ["k"]).collect()} == {1}
    assert ordering.with_half(df.limit(0), ["ts"]).count() == 0


@pytest.mark.parametrize("keys", [None, ["machine_id"]])
@pytest.mark.parametrize("chunks", [1, 3, 40])
def test_long_span_equals_the_recursion(spark, keys, chunks):
    """A hot machine over many chunks, chunks of one row, absent values; the plan does not know the span."""
    from millwright.operators import features
    rows = [(i, 1 if i % 10 else i % 7, i * 37 % 400, None if i % 9 == 0 else float((i * 31) % 97)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, machine_id int, ts long, x double")
    got = features.ewm_carried(df, "x", 1000, "m", partition_by=keys, num_chunks=chunks)
    q, states, expected = 1 - 2 / 1001, {}, {}
    for i, m, _, x in sorted(rows, key=lambda r: (r[2], r[0])):
        n, d = states.get(m if keys else 0, (0.0, 0.0))
        n, d = (n * q + (x or 0.0), d * q + (x is not None))
        states[m if keys else 0] = (n, d)
        expected[i] = n / d if d else None
    out = {r["event_id"]: r["m"] for r in got.collect()}
    assert out.keys() == expected.keys()
    assert all((out[i] is None) == (e is None) and (e is None or abs(out[i] - e) < 1e-9) for i, e in expected.items())
    short = features.ewm_carried(df, "x", 5, "m", partition_by=keys, num_chunks=chunks)
    plans = [f._jdf.queryExecution().analyzed().toString() for f in (got, short)]
    assert plans[0].count("\n") == plans[1].count("\n")
