"""Registered model queries: scaling, weights, scoring, votes, attributions (O)
and trained Spark ML models (R: rows-only, no exact SQL equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import rules
from ..operators import attribution, cleaning, ordering
from ..operators.features import MODEL_FEATURES
from ..plans import scoring, training
from ..plans.scoring import LINEAR_MODELS, linear_logit_sql
from ..sources import messages
from .base_sql import with_views
from .ordered import _feature_sql
from .sources_q import _live_readings

SENS = ", ".join(rules.SENSORS)
M1 = LINEAR_MODELS["m1"]


def q_standard_scale(spark, d):
    s = ordering.time_split(fx.sensors(spark, d).select("event_id", "ts", *rules.SENSORS), ["ts", "event_id"], 0.2)
    scaler = training.fit_scaler(s.filter(F.col("split") == "train"), rules.SENSORS)
    out = training.apply_scaler(s, scaler, rules.SENSORS)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in rules.SENSORS])


def _scale_sql():
    stats = ", ".join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0e0 END AS sd_{c}"
                      for c in rules.SENSORS)
    cols = ", ".join(f"round(({c} - mu_{c}) / sd_{c}, 6) AS {c}" for c in rules.SENSORS)
    return with_views(f"""
, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS total FROM sensors)
, st AS (SELECT {stats} FROM n WHERE pos < CAST(floor(total * 0.8e0) AS BIGINT))
SELECT event_id, {cols} FROM n, st""", "sensors")


def q_class_weights(spark, d):
    return training.class_weights(fx.sensors(spark, d))


SQL_WEIGHTS = with_views("""
SELECT machine_failure AS class, count(*) AS count, (SELECT count(*) FROM sensors) / (2.0e0 * count(*)) AS weight
FROM sensors GROUP BY machine_failure""", "sensors")


def q_score_linear(spark, d):
    return fx.predictions(spark, d).select("event_id", "prediction", "failure_probability", "normal_probability",
                                           "risk_level")


SQL_SCORE = with_views("""
SELECT event_id, prediction, failure_probability, normal_probability, risk_level FROM predictions""", "predictions")


def q_ensemble_votes(spark, d):
    return fx.predictions(spark, d).select("event_id", "vote_m2", "vote_m1", "vote_m3", "vote_m4",
                                           "ensemble_agreement")


SQL_VOTES = with_views("""
SELECT event_id, vote_m2, vote_m1, vote_m3, vote_m4, ensemble_agreement FROM predictions""", "predictions")


def q_score_live(spark, d):
    """Live readings -> model schema (engineered features 0) -> score."""
    accepted, _ = messages.live_ingest(_live_readings(spark, d))
    aligned = accepted.select("machine_id", "received_at", *[
        F.col(c).cast("double").alias(c) if c in accepted.columns else F.lit(0.0).alias(c) for c in MODEL_FEATURES])
    scored = scoring.score_linear(aligned)
    return scored.select("machine_id", "received_at", "failure_probability", "risk_level", "ensemble_agreement")


def _live_score_sql():
    chosen = linear_logit_sql(M1)
    return with_views(f"""
, live AS (SELECT trim(' machine_' || CAST(machine_id AS VARCHAR)) AS machine_id, ts AS received_at, air_temp,
                  process_temp, rotational_speed, CASE WHEN event_id % 5 = 0 THEN 0.0e0 ELSE torque END AS torque,
                  tool_wear FROM sensors WHERE event_id % 7 <> 0)
, sc AS (SELECT *, ROUND(1.0e0/(1.0e0+EXP(-({chosen}))), 6) AS failure_probability,
    {' + '.join(['1'] + [f"CASE WHEN (CASE WHEN {linear_logit_sql(LINEAR_MODELS[m])} >= 0 THEN 1 ELSE 0 END) = (CASE WHEN {linear_logit_sql(LINEAR_MODELS['m2'])} >= 0 THEN 1 ELSE 0 END) THEN 1 ELSE 0 END" for m in ('m1', 'm3', 'm4')])} AS same
  FROM live)
SELECT machine_id, received_at, failure_probability,
       CASE WHEN failure_probability >= 0.8e0 THEN 'CRITICAL' WHEN failure_probability >= 0.5e0 THEN 'HIGH'
            WHEN failure_probability >= 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       ROUND(same / 4.0e0, 2) AS ensemble_agreement FROM sc""", "sensors")


def _linear_long(spark, d):
    return attribution.linear_attribution(fx.sensors(spark, d), M1)


def q_linear_attribution(spark, d):
    return _linear_long(spark, d).select("event_id", "feature", F.round("phi", 6).alias("phi"))


def _phi_sql():
    names = ["torque", "tool_wear", "air_temp", "process_temp", "rotational_speed"]
    means = ", ".join(f"avg({n}) AS mu_{n}" for n in names)
    unions = " UNION ALL ".join(
        f"SELECT event_id, '{n}' AS feature, {w!r}e0 * ({n} - mu_{n}) AS phi FROM sensors, m"
        if "e" not in repr(w) else f"SELECT event_id, '{n}' AS feature, {w!r} * ({n} - mu_{n}) AS phi FROM sensors, m"
        for w, n in zip(M1[1:], names))
    return f"""
, m AS (SELECT {means} FROM sensors)
, phi AS ({unions})"""


SQL_PHI = with_views(_phi_sql() + "\nSELECT event_id, feature, round(phi, 6) AS phi FROM phi", "sensors")


def q_top3_attribution(spark, d):
    return attribution.linear_top_k(fx.sensors(spark, d), M1, 3)


SQL_TOP3 = with_views(_phi_sql() + """
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) AS INTEGER) AS rank,
       feature, round(phi, 4) AS impact FROM phi
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(phi) DESC, feature) <= 3""", "sensors")


def q_global_importance(spark, d):
    return attribution.global_importance(_linear_long(spark, d)).select(
        "feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


SQL_GLOBAL = with_views(_phi_sql() + """
SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_shap FROM phi GROUP BY feature""", "sensors")


# --- trained models (rows-only checks) ---------------------------------------------------------
def _split(spark, d):
    frame = training.training_frame(fx.sensors(spark, d))
    return training.time_split(frame)


def _report(kind, scores, train, test):
    """Sizes of the split, whether all metrics are in range, and whether the model beats chance on the later part."""
    in_range = F.lit(True)
    for c in ("pr_auc", "average_precision", "precision", "recall", "f1"):
        in_range = in_range & F.col(c).between(0.0, 1.0)
    sizes = train.agg(F.count(F.lit(1)).alias("train_rows")).crossJoin(
        test.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("machine_failure") == 1).alias("test_failures")))
    return scores.crossJoin(sizes).select(F.lit(kind).alias("model"), "train_rows", "test_rows", "test_failures", in_range.alias("metrics_in_range"),
                                          (F.col("average_precision") > 2 * F.col("test_failures") / F.col("test_rows")).alias("beats_chance"))


def _train(spark, d, kind):
    train, test = _split(spark, d)
    train = training.with_weights(train, training.class_weights(train))
    model = training.fit(train, MODEL_FEATURES, kind)
    return _report(kind, training.evaluate(model, test, MODEL_FEATURES), train, test)


def _train_boosted(spark, d, kind):
    train, test = _split(spark, d)
    model = training.fit_boosted_pair(train, MODEL_FEATURES, [kind])[kind]
    return _report(kind, training.evaluate_boosted(model, test), train, test)


def q_train_lr(spark, d):
    return _train(spark, d, "lr")


def q_train_rf(spark, d):
    """M4: 200 trees of depth 30."""
    train, test = _split(spark, d)
    return _report("rf", training.evaluate_forest(training.fit_forest(train, MODEL_FEATURES), test), train, test)


def q_train_gbt(spark, d):
    """M5: 200 rounds of depth 6 by depth."""
    return _train_boosted(spark, d, "gbt")


def q_train_gbt_b(spark, d):
    """M6: 200 rounds of depth 6, best leaf first up to 31 leaves."""
    return _train_boosted(spark, d, "gbt_b")


def q_model_roundtrip(spark, d):
    """M8: a saved and reloaded boosted model scores every test row exactly as the fitted one."""
    train, test = _split(spark, d)
    model = training.fit_boosted_pair(train, MODEL_FEATURES, ["gbt"])["gbt"]
    again = training.load_boosted(spark, training.save_boosted(spark, model))
    scored = training.boosted_scores(training.dealt(test.select("event_id", *MODEL_FEATURES)), {"a": model, "b": again})
    return scored.select("event_id", ((F.col("margin_a") == F.col("margin_b")) & (F.col("p_a") == F.col("p_b"))).alias("same"))


def q_tune_search(spark, d):
    """M9: 50 trials over the library's space; count, range checks and the best row."""
    train, test = _split(spark, d)
    trials = training.tune(train, test, MODEL_FEATURES)
    inside = F.lit(True)
    for c, (low, high, kind) in training.SEARCH_SPACE.items():
        inside = inside & F.col(c).between(low - 1e-9, high + 1e-9)
        if kind == "int":
            inside = inside & (F.col(c) == F.floor(c))
    share = test.agg((F.count_if(F.col("machine_failure") == 1) / F.count(F.lit(1))).alias("_share"))
    return trials.agg(F.count_distinct("trial").alias("trials"), F.count_if(inside).alias("inside"),
                      F.max("pr_auc").alias("_best"), F.min("pr_auc").alias("_least")).crossJoin(share).select(
        "trials", "inside", F.col("_best").between(F.col("_least"), 1.0).alias("best_in_range"), (F.col("_best") > 2 * F.col("_share")).alias("beats_chance"))


SQL_TUNE = "SELECT CAST(50 AS BIGINT) AS trials, CAST(50 AS BIGINT) AS inside, true AS best_in_range, true AS beats_chance"


def q_sampled_attribution(spark, d):
    """Sums of the sampled values per test row; they telescope to f(x) - f(background mean)."""
    phi = _sampled(spark, d)
    return phi.groupBy("event_id").agg(F.round(F.sum("phi"), 6).alias("total"), F.count(F.lit(1)).alias("features"))


def _sampled_sql():
    mean = {n: f"(SELECT avg({n}) FROM part WHERE pos < cut)" for n in rules.SENSORS}

    def p(air, process, speed, torque, wear):
        # The chosen scorer, written out: -5 + 0.06 torque + 0.012 wear + 0.1 (air - 300)
        return f"round(1.0e0 / (1.0e0 + exp(-(-5.0e0 + 0.06e0 * {torque} + 0.012e0 * {wear} + 0.1e0 * ({air} - 300.0e0)))), 6)"
    order = ("air_temp", "process_temp", "rotational_speed", "torque", "tool_wear")
    return with_views(f"""
, part AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, CAST(floor(count(*) OVER () * 0.8e0) AS BIGINT) AS cut FROM sensors)
, base AS (SELECT {p(*[mean[n] for n in order])} AS b)
SELECT event_id, round({p(*order)} - b, 6) AS total, 5 AS features FROM part, base WHERE pos >= cut""", "sensors")


def _sampled(spark, d):
    """Permutation Shapley of the chosen linear scorer on the test part, scored in one pass."""
    s = cleaning.one_hot(fx.sensors(spark, d), "type", prefix="Type")
    split = ordering.time_split(s, ["ts", "event_id"], 0.2)
    test = split.filter(F.col("split") == "test")

    def score(frame):
        return frame.withColumn("failure_probability", scoring.probability(scoring.linear_logit(M1)))
    return attribution.sampled_shapley(test, rules.SENSORS, score, split.filter(F.col("split") == "train"))


def q_kernel_attribution(spark, d):
    """Kernel Shapley values of the chosen scorer's logit on the test part, against the first 100 training rows."""
    split = ordering.time_split(fx.sensors(spark, d), ["ts", "event_id"], 0.2)
    test, train = split.filter(F.col("split") == "test"), split.filter(F.col("split") == "train")

    def score(frame):
        return frame.withColumn("logit", scoring.linear_logit(M1))
    phi = attribution.kernel_shapley(test, rules.SENSORS, score, train, order_by=["ts", "event_id"], value="logit")
    return phi.select("event_id", "feature", (F.round("phi", 5) + F.lit(0.0)).alias("phi"))


def _kernel_sql():
    weights = dict(zip([t.split(" - ")[0] for t in scoring.TERMS], M1[1:]))
    unions = " UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, round({weights[c]!r} * ({c} - mu_{c}), 5) + 0.0e0 AS phi FROM part, m WHERE pos >= cut"
                                for c in rules.SENSORS)
    return with_views(f"""
, part AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, CAST(floor(count(*) OVER () * 0.8e0) AS BIGINT) AS cut FROM sensors)
, m AS (SELECT {', '.join(f'avg({c}) AS mu_{c}' for c in rules.SENSORS)} FROM part WHERE pos < least(cut, 100))
{unions}""", "sensors")


def q_tree_attribution(spark, d):
    """Path-dependent attributions of boosted model A (200 rounds of depth 6) for every test row; they add up to its margin."""
    train, test = _split(spark, d)
    model = training.fit_boosted_pair(train, MODEL_FEATURES, ["gbt"])["gbt"]
    rows = training.boosted_scores(training.dealt(test.select("event_id", *MODEL_FEATURES)), {"a": model})
    total = attribution.tree_attribution(rows, model, MODEL_FEATURES).groupBy("event_id").agg(
        F.sum("phi").alias("_phi"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("phi") != 0).alias("_used"))
    return total.join(rows.select("event_id", "margin_a"), "event_id").select(
        "event_id", "parts", ((F.abs(F.col("_phi") - F.col("margin_a")) < 1e-8) & (F.col("_used") > 1)).alias("adds_up"))


def _test_rows_sql(columns: str) -> str:
    """Rows of the time-later fifth of the feature table."""
    return with_views(f"""
, made AS ({_feature_sql()})
, part AS (SELECT m.event_id, s.machine_failure, row_number() OVER (ORDER BY s.ts, s.event_id) - 1 AS pos,
                  CAST(floor(count(*) OVER () * 0.8e0) AS BIGINT) AS cut FROM made m JOIN sensors s ON s.event_id = m.event_id)
SELECT {columns}""", "sensors")


def _train_sql(kind: str) -> str:
    return _test_rows_sql(f"""'{kind}' AS model, count_if(pos < cut) AS train_rows, count_if(pos >= cut) AS test_rows,
       count_if(pos >= cut AND machine_failure = 1) AS test_failures, true AS metrics_in_range, true AS beats_chance FROM part""")


QUERIES = {
    "standard_scale": (q_standard_scale, _scale_sql()),
    "class_weights": (q_class_weights, SQL_WEIGHTS),
    "score_linear": (q_score_linear, SQL_SCORE),
    "ensemble_votes": (q_ensemble_votes, SQL_VOTES),
    "score_live": (q_score_live, _live_score_sql()),
    "linear_attribution": (q_linear_attribution, SQL_PHI),
    "top3_attribution": (q_top3_attribution, SQL_TOP3),
    "global_importance": (q_global_importance, SQL_GLOBAL),
    "train_lr": (q_train_lr, _train_sql("lr")),
    "train_rf": (q_train_rf, _train_sql("rf")),
    "train_gbt": (q_train_gbt, _train_sql("gbt")),
    "train_gbt_b": (q_train_gbt_b, _train_sql("gbt_b")),
    "model_roundtrip": (q_model_roundtrip, _test_rows_sql("event_id, true AS same FROM part WHERE pos >= cut")),
    "tune_search": (q_tune_search, SQL_TUNE),
    "sampled_attribution": (q_sampled_attribution, _sampled_sql()),
    "kernel_attribution": (q_kernel_attribution, _kernel_sql()),
    "tree_attribution": (q_tree_attribution, _test_rows_sql("event_id, 17 AS parts, true AS adds_up FROM part WHERE pos >= cut")),
}
