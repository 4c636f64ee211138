"""Registered evaluation-metric queries (E*, M7) over the scored sensor view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import metrics
from .base_sql import with_views


def q_confusion_matrix(spark, d):
    return metrics.confusion_matrix(fx.predictions(spark, d))


SQL_CM = with_views("""
SELECT count_if(machine_failure = 0 AND prediction = 0) AS tn, count_if(machine_failure = 0 AND prediction = 1) AS fp,
       count_if(machine_failure = 1 AND prediction = 0) AS fn, count_if(machine_failure = 1 AND prediction = 1) AS tp
FROM predictions""", "predictions")


def q_classification_metrics(spark, d):
    return metrics.classification_metrics(fx.predictions(spark, d))


SQL_CLS = with_views("""
, cm AS (SELECT count_if(machine_failure = 0 AND prediction = 0) AS tn,
                count_if(machine_failure = 0 AND prediction = 1) AS fp,
                count_if(machine_failure = 1 AND prediction = 0) AS fn,
                count_if(machine_failure = 1 AND prediction = 1) AS tp FROM predictions)
SELECT tn, fp, fn, tp,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0e0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0e0 END, 6) AS f1,
  round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0e0 END, 6) AS accuracy
FROM cm""", "predictions")

POINTS = """
, g AS (SELECT failure_probability AS threshold, count_if(machine_failure = 1) AS pos,
               count_if(machine_failure <> 1) AS neg FROM predictions GROUP BY 1)
, t AS (SELECT count_if(machine_failure = 1) AS P, count_if(machine_failure <> 1) AS N FROM predictions)
, c AS (SELECT g.*, t.P, t.N, row_number() OVER (ORDER BY threshold) - 1 AS position,
               sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
               sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps
        FROM g, t)
, pts AS (SELECT *, CASE WHEN tps + fps > 0 THEN tps / (tps + fps) ELSE 0.0e0 END AS precision,
                 CASE WHEN P > 0 THEN tps / P ELSE 1.0e0 END AS recall,
                 CASE WHEN (tps - pos) + (fps - neg) > 0 THEN (tps - pos) / ((tps - pos) + (fps - neg))
                      ELSE 1.0e0 END AS prev_precision,
                 CASE WHEN P > 0 THEN (tps - pos) / P ELSE 1.0e0 END AS prev_recall FROM c)
, curve AS (SELECT CAST(position AS BIGINT) AS position, threshold, precision, recall FROM pts
            UNION ALL SELECT CAST(max(position) + 1 AS BIGINT), CAST(NULL AS DOUBLE), 1.0e0, 0.0e0 FROM pts)"""


def q_pr_curve(spark, d):
    c = metrics.pr_curve(fx.predictions(spark, d))
    return c.select("position", "threshold", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


SQL_CURVE = with_views(POINTS + """
SELECT position, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve""", "predictions")


def q_pr_auc(spark, d):
    return metrics.pr_summary(fx.predictions(spark, d)).select("pr_auc")


SQL_AUC = with_views(POINTS + """
SELECT round(sum((recall - prev_recall) * (precision + prev_precision) / 2), 6) AS pr_auc FROM pts""", "predictions")


def q_average_precision(spark, d):
    return metrics.pr_summary(fx.predictions(spark, d)).select("average_precision")


SQL_AP = with_views(POINTS + """
SELECT round(sum((recall - prev_recall) * precision), 6) AS average_precision FROM pts""", "predictions")


def q_pr_baseline(spark, d):
    return metrics.pr_summary(fx.predictions(spark, d)).select("pr_baseline")


SQL_BASELINE = with_views(POINTS + """
SELECT round(avg(precision), 6) AS pr_baseline FROM curve""", "predictions")


def q_pr_curve_thin(spark, d):
    c = metrics.pr_curve_thin(metrics.pr_curve(fx.predictions(spark, d)))
    return c.select("position", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


SQL_THIN = with_views(POINTS + """
SELECT position, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve
WHERE position % greatest(1, (SELECT count(*) FROM curve) // 100) = 0""", "predictions")


def q_classification_report(spark, d):
    return metrics.classification_report(fx.predictions(spark, d))


SQL_REPORT = with_views("""
, cm AS (SELECT count_if(machine_failure = 0 AND prediction = 0) AS tn,
                count_if(machine_failure = 0 AND prediction = 1) AS fp,
                count_if(machine_failure = 1 AND prediction = 0) AS fn,
                count_if(machine_failure = 1 AND prediction = 1) AS tp FROM predictions)
, b AS (SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0e0 END AS p0,
               CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0e0 END AS r0,
               CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END AS p1,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0e0 END AS r1,
               tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n FROM cm)
, f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0e0 END AS f0,
               CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0e0 END AS f1 FROM b)
SELECT 'Normal' AS class, round(p0, 4) AS precision, round(r0, 4) AS recall, round(f0, 4) AS f1_score, s0 AS support FROM f
UNION ALL SELECT 'Failure', round(p1, 4), round(r1, 4), round(f1, 4), s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CASE WHEN n > 0 THEN (tp + tn) / n ELSE 0.0e0 END, 4), n FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 4), round((r0 + r1) / 2, 4), round((f0 + f1) / 2, 4), n FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 4), round((r0 * s0 + r1 * s1) / n, 4),
                 round((f0 * s0 + f1 * s1) / n, 4), n FROM f""", "predictions")


def q_evaluation_report(spark, d):
    return metrics.evaluation_report(fx.predictions(spark, d), "m1")


def _report_sql():
    def line(name, col):
        return f"printf('{name:<21}%.4f', round({col}, 4))"
    return with_views(POINTS + f"""
, s AS (SELECT sum((recall - prev_recall) * (precision + prev_precision) / 2) AS pr_auc,
               sum((recall - prev_recall) * precision) AS average_precision FROM pts)
, cm AS (SELECT count_if(machine_failure = 0 AND prediction = 0) AS tn,
                count_if(machine_failure = 0 AND prediction = 1) AS fp,
                count_if(machine_failure = 1 AND prediction = 0) AS fn,
                count_if(machine_failure = 1 AND prediction = 1) AS tp FROM predictions)
, m AS (SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END, 6) AS precision,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0e0 END, 6) AS recall,
               round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0e0 END, 6) AS f1 FROM cm)
SELECT 'm1' AS model, concat_ws(chr(10), 'Model Evaluation Report', 'Model: m1',
  {line('Precision:', 'm.precision')}, {line('Recall:', 'm.recall')}, {line('F1 Score:', 'm.f1')},
  {line('PR-AUC:', 'round(s.pr_auc, 6)')}, {line('Average Precision:', 'round(s.average_precision, 6)')},
  printf('Confusion: TN=%d FP=%d FN=%d TP=%d', tn, fp, fn, tp)) AS report FROM m, s""", "predictions")


def _model_metrics(spark, d):
    """Per-model metrics of the four linear scorers, listed in ensemble order (rank)."""
    from ..plans.scoring import ENSEMBLE_ORDER, LINEAR_MODELS, linear_logit, probability
    s = fx.sensors(spark, d)
    frames = []
    for rank, m in enumerate(ENSEMBLE_ORDER):
        scored = s.select("machine_failure", probability(linear_logit(LINEAR_MODELS[m])).alias("failure_probability"),
                          F.when(linear_logit(LINEAR_MODELS[m]) >= 0, 1).otherwise(0).alias("prediction"))
        summ = metrics.pr_summary(scored).crossJoin(metrics.classification_metrics(scored).select("f1"))
        frames.append(summ.select(F.lit(m).alias("model"), F.lit(rank).alias("rank"), "pr_auc", "f1"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def q_select_best(spark, d):
    """M7: best PR-AUC among the four scorers; the earlier-listed wins ties."""
    return metrics.select_best(_model_metrics(spark, d))


def _select_best_sql():
    from ..plans.scoring import ENSEMBLE_ORDER, LINEAR_MODELS, linear_logit_sql
    parts = []
    for rank, m in enumerate(ENSEMBLE_ORDER):
        lg = linear_logit_sql(LINEAR_MODELS[m])
        parts.append(f"""SELECT '{m}' AS model, {rank} AS rank, * FROM (
  WITH sc AS (SELECT machine_failure, ROUND(1.0e0/(1.0e0+EXP(-({lg}))), 6) AS p,
                     CASE WHEN {lg} >= 0 THEN 1 ELSE 0 END AS pred FROM sensors),
  g AS (SELECT p AS threshold, count_if(machine_failure = 1) AS pos, count_if(machine_failure <> 1) AS neg
        FROM sc GROUP BY 1),
  t AS (SELECT count_if(machine_failure = 1) AS P, count_if(machine_failure <> 1) AS N,
               count_if(machine_failure = 1 AND pred = 1) AS tp, count_if(machine_failure = 0 AND pred = 1) AS fp,
               count_if(machine_failure = 1 AND pred = 0) AS fn FROM sc),
  c AS (SELECT g.*, t.P, t.N,
               sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tps,
               sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fps
        FROM g, t),
  pts AS (SELECT *, tps / (tps + fps) AS prec, tps / P AS rec,
                 CASE WHEN (tps - pos) + (fps - neg) > 0 THEN (tps - pos) / ((tps - pos) + (fps - neg)) ELSE 1.0e0 END
                   AS pprec, (tps - pos) / P AS prec_r FROM c)
  SELECT round(sum((rec - prec_r) * (prec + pprec) / 2), 6) AS pr_auc,
         (SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0e0 END, 6) FROM t)
           AS f1
  FROM pts)""")
    return with_views("\nSELECT * FROM (" + " UNION ALL ".join(parts) + ") ORDER BY pr_auc DESC, rank LIMIT 1",
                      "sensors")


QUERIES = {
    "confusion_matrix": (q_confusion_matrix, SQL_CM),
    "classification_metrics": (q_classification_metrics, SQL_CLS),
    "pr_curve": (q_pr_curve, SQL_CURVE),
    "pr_auc": (q_pr_auc, SQL_AUC),
    "average_precision": (q_average_precision, SQL_AP),
    "pr_baseline": (q_pr_baseline, SQL_BASELINE),
    "pr_curve_thin": (q_pr_curve_thin, SQL_THIN),
    "classification_report": (q_classification_report, SQL_REPORT),
    "evaluation_report": (q_evaluation_report, _report_sql()),
    "select_best": (q_select_best, _select_best_sql()),
}
