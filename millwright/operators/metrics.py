"""Evaluation metrics (E1-E9), exact and distributed.

The precision-recall curve is one aggregate per distinct score plus a chunked
running sum (``ordering.running_sums``) - no single-partition window.  Each
curve point carries its own counts, so the previous point (higher threshold)
is derived on the same row: PR-AUC and average precision need no lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from . import ordering


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion_matrix(df: DataFrame, label="machine_failure", pred="prediction") -> DataFrame:
    """Tn, fp, fn, tp in one row."""
    y, p = _c(label), _c(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy from a confusion row; 0 when undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    total = tp + fp + fn + tn
    accuracy = F.when(total > 0, (tp + tn) / total).otherwise(F.lit(0.0))
    return cm.select("tn", "fp", "fn", "tp", F.round(precision, 6).alias("precision"),
                     F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"),
                     F.round(accuracy, 6).alias("accuracy"))


def classification_metrics(df: DataFrame, label="machine_failure", pred="prediction") -> DataFrame:
    return metrics_from_confusion(confusion_matrix(df, label, pred))


def _curve_counts(df: DataFrame, label, score) -> tuple[DataFrame, DataFrame]:
    y = _c(label)
    per_score = df.groupBy(_c(score).cast("double").alias("threshold")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    totals = per_score.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    return per_score, totals


def pr_points(df: DataFrame, label="machine_failure", score="failure_probability") -> DataFrame:
    """Per distinct score: tps/fps at threshold, precision, recall, and the previous (higher) point."""
    per_score, totals = _curve_counts(df, label, score)
    cum = ordering.running_sums(per_score, ["pos", "neg"], ["threshold"])
    cum = cum.crossJoin(F.broadcast(totals))  # one row
    tps = F.col("P") - F.col("pos_cum") + F.col("pos")
    fps = F.col("N") - F.col("neg_cum") + F.col("neg")
    pts = cum.select(F.col(ordering.POS).alias("position"), "threshold", "pos", "neg", "P", "N",
                     tps.alias("tps"), fps.alias("fps"))
    prec = F.when(F.col("tps") + F.col("fps") > 0, F.col("tps") / (F.col("tps") + F.col("fps"))).otherwise(0.0)
    rec = F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(F.lit(1.0))
    ptp, pfp = F.col("tps") - F.col("pos"), F.col("fps") - F.col("neg")
    prev_prec = F.when(ptp + pfp > 0, ptp / (ptp + pfp)).otherwise(F.lit(1.0))
    prev_rec = F.when(F.col("P") > 0, ptp / F.col("P")).otherwise(F.lit(1.0))
    return pts.select("*", prec.alias("precision"), rec.alias("recall"),
                      prev_prec.alias("prev_precision"), prev_rec.alias("prev_recall"))


def pr_curve(df: DataFrame, label="machine_failure", score="failure_probability") -> DataFrame:
    """One point per distinct score in ascending threshold order, plus (recall 0, precision 1)."""
    pts = pr_points(df, label, score)
    curve = pts.select("position", "threshold", "precision", "recall")
    end = pts.agg((F.max("position") + 1).alias("position")).select(
        "position", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return curve.unionByName(end.filter(F.col("position").isNotNull()))


def pr_summary(df: DataFrame, label="machine_failure", score="failure_probability") -> DataFrame:
    """Trapezoid PR-AUC, average precision, mean curve precision."""
    pts = pr_points(df, label, score)
    trap = (F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2
    ap = (F.col("recall") - F.col("prev_recall")) * F.col("precision")
    agg = pts.agg(F.coalesce(F.sum(trap), F.lit(0.0)).alias("pr_auc"), F.coalesce(F.sum(ap), F.lit(0.0)).alias("average_precision"),
                  F.coalesce(F.sum("precision"), F.lit(0.0)).alias("_ps"), F.count(F.lit(1)).alias("_n"))
    return agg.select(F.round("pr_auc", 6).alias("pr_auc"), F.round("average_precision", 6).alias("average_precision"),
                      F.round((F.col("_ps") + 1.0) / (F.col("_n") + 1), 6).alias("pr_baseline"))


def pr_curve_thin(curve: DataFrame, target_points: int = 100) -> DataFrame:
    """Every step-th point, step = max(1, n div target_points), in curve order."""
    n = curve.agg(F.count(F.lit(1)).alias("_n"))
    out = curve.crossJoin(F.broadcast(n))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / target_points))
    return out.filter(F.pmod(F.col("position"), step) == 0).drop("_n")


def _class_shares(cm: DataFrame) -> DataFrame:
    """A confusion row with precision, recall, F1 and support per class (0, 1), accuracy and weighted means; 0 when undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p0, r0 = safe(tn, tn + fn), safe(tn, tn + fp)
    p1, r1 = safe(tp, tp + fp), safe(tp, tp + fn)
    f0, f1 = safe(2 * p0 * r0, p0 + r0), safe(2 * p1 * r1, p1 + r1)
    s0, s1 = tn + fp, tp + fn
    total = s0 + s1
    return cm.select("tn", "fp", "fn", "tp", p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                     p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"), total.alias("n"),
                     safe(tp + tn, total).alias("acc"), safe(p0 * s0 + p1 * s1, total).alias("wp"),
                     safe(r0 * s0 + r1 * s1, total).alias("wr"), safe(f0 * s0 + f1 * s1, total).alias("wf"))


def classification_report(df: DataFrame, label="machine_failure", pred="prediction",
                          names=("Normal", "Failure")) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    wide = _class_shares(confusion_matrix(df, label, pred))
    long = wide.selectExpr(
        "stack(5, "
        f"'{names[0]}', p0, r0, f0, s0, "
        f"'{names[1]}', p1, r1, f1, s1, "
        "'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), acc, n, "
        "'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n, "
        "'weighted avg', wp, wr, wf, n"
        ") AS (class, precision, recall, f1_score, support)")
    return long.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1_score")],
                       F.col("support").cast("long").alias("support"))


def evaluation_report(df: DataFrame, model_name: str, label="machine_failure", pred="prediction",
                      score="failure_probability") -> DataFrame:
    """E8 in short: metrics and counts as one text (``evaluation_text`` is the full one)."""
    m = classification_metrics(df, label, pred)
    s = pr_summary(df, label, score)
    row = m.crossJoin(s)

    def fmt(name, col):
        return F.format_string(f"{name:<21}%.4f", F.round(col, 4))
    lines = [F.lit("Model Evaluation Report"), F.lit(f"Model: {model_name}"),
             fmt("Precision:", F.col("precision")), fmt("Recall:", F.col("recall")),
             fmt("F1 Score:", F.col("f1")), fmt("PR-AUC:", F.col("pr_auc")),
             fmt("Average Precision:", F.col("average_precision")),
             F.format_string("Confusion: TN=%d FP=%d FN=%d TP=%d", "tn", "fp", "fn", "tp")]
    return row.select(F.lit(model_name).alias("model"), F.concat_ws("\n", *lines).alias("report"))


# Titles, order, widths and digits of the evaluation text.
RULE = "=" * 60
METRIC_TITLE, CLASS_TITLE, MATRIX_TITLE = "--- Primary Metrics ---", "--- Classification Report ---", "--- Confusion Matrix ---"
METRIC_LINES = (("Precision:", "p1"), ("Recall:", "r1"), ("F1 Score:", "f1"), ("PR-AUC:", "pr_auc"), ("Average Precision:", "average_precision"))
METRIC_WIDTH, CLASS_WIDTH, CELL_WIDTH = 21, 12, 10


def evaluation_text(df: DataFrame, model_name: str, label="machine_failure", pred="prediction", score="failure_probability",
                    names=("Normal", "Failure")) -> DataFrame:
    """E8 in full: title, primary metrics (4 digits), report per class (2 digits) and confusion matrix as one text.

    Two passes over ``df``: the confusion counts, from which all shares follow, and the curve.  Halves
    are rounded up.  Without rows all shares are 0.
    """
    row = _class_shares(confusion_matrix(df, label, pred)).crossJoin(pr_summary(df, label, score))  # one row each

    def cells(name, *values):
        shown = [F.format_string(" %9.2f", rules.round_half_up(F.expr(v), 2)) if v else F.lit(" " * 10) for v in values]
        return F.concat(F.lit(f"{name:>{CLASS_WIDTH}} "), *shown)

    def counted(line, support):
        return F.concat(line, F.format_string(" %9d", F.col(support)))

    def matrix(name, *counts):
        return F.concat(F.lit(f"{'Actual ' + name:<17}"), F.format_string(f"%{CELL_WIDTH}d{' ' * 7}%{CELL_WIDTH}d", *counts))
    lines = [
        F.lit(RULE), F.lit("Model Evaluation Report"), F.lit(RULE), F.lit(""), F.lit(f"Model: {model_name}"), F.lit(""),
        F.lit(METRIC_TITLE),
        *[F.format_string(f"{name:<{METRIC_WIDTH}}%.4f", rules.round_half_up(c, 4)) for name, c in METRIC_LINES], F.lit(""),
        F.lit(CLASS_TITLE), F.lit(" " * (CLASS_WIDTH + 1) + "".join(f" {h:>9}" for h in ("precision", "recall", "f1-score", "support"))), F.lit(""),
        counted(cells(names[0], "p0", "r0", "f0"), "s0"), counted(cells(names[1], "p1", "r1", "f1"), "s1"), F.lit(""),
        counted(cells("accuracy", None, None, "acc"), "n"),
        counted(cells("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2"), "n"),
        counted(cells("weighted avg", "wp", "wr", "wf"), "n"), F.lit(""),
        F.lit(MATRIX_TITLE), F.lit(" " * 15 + f"Predicted {names[0]}  Predicted {names[1]}"),
        matrix(names[0], "tn", "fp"), matrix(names[1], "fn", "tp")]
    return row.select(F.lit(model_name).alias("model"), F.concat_ws("\n", *lines).alias("report"))


def select_best(metrics: DataFrame, by: str = "pr_auc", rank_col: str = "rank") -> DataFrame:
    """M7: best row by ``by`` descending; the earliest-listed model wins ties."""
    return metrics.orderBy(F.col(by).desc(), F.col(rank_col).asc()).limit(1)
