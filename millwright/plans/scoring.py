"""Scoring (M10-M12): linear scorers as data, Spark ML model transforms, votes.

The linear scorer is the SQL-checkable form of a trained model: a logit is a
fixed-order sum of weighted sensor terms, so Spark and the DuckDB oracle build
the *same* expression tree and agree bit for bit before rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

# The four linear scorers of the test fixture.
# terms: bias, torque, tool_wear, (air_temp - 300), (process_temp - 310), rotational_speed
LINEAR_MODELS = {
    "m1": (-5.0, 0.06, 0.012, 0.10, 0.0, 0.0),
    "m2": (-4.5, 0.05, 0.012, 0.0, 0.0, 0.0),
    "m3": (-4.0, 0.07, 0.0, 0.0, 0.10, 0.0),
    "m4": (-5.5, 0.05, 0.012, 0.0, 0.0, 0.0005),
}
CHOSEN_MODEL = "m1"
ENSEMBLE_ORDER = ("m2", "m1", "m3", "m4")
TERMS = ("torque", "tool_wear", "air_temp - 300", "process_temp - 310", "rotational_speed")


def _sql_num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def _term_col(term: str) -> Column:
    if " - " in term:
        name, offset = term.split(" - ")
        return F.col(name) - F.lit(float(offset))
    return F.col(term)


def linear_logit(coefs: Sequence[float]) -> Column:
    """Left-associative Σ w_i * term_i (same tree as ``linear_logit_sql``)."""
    expr = F.lit(float(coefs[0]))
    for w, term in zip(coefs[1:], TERMS):
        expr = expr + F.lit(float(w)) * _term_col(term)
    return expr


def linear_logit_sql(coefs: Sequence[float]) -> str:
    expr = _sql_num(coefs[0])
    for w, term in zip(coefs[1:], TERMS):
        t = term if " - " not in term else f"({term.split(' - ')[0]} - {_sql_num(float(term.split(' - ')[1]))})"
        expr = f"({expr} + {_sql_num(w)} * {t})"
    return expr


def probability(logit: Column, digits: int = 6) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), digits)


def score_linear(df: DataFrame, models: dict | None = None, chosen: str = CHOSEN_MODEL,
                 ensemble: Sequence[str] = ENSEMBLE_ORDER, digits: int = 6) -> DataFrame:
    """Probability, band, prediction and the four-model vote in one projection."""
    models = models or LINEAR_MODELS
    logit = linear_logit(models[chosen])
    p = probability(logit, digits)
    votes = {m: F.when(linear_logit(models[m]) >= 0, 1).otherwise(0) for m in ensemble}
    out = df.select(
        "*",
        F.when(logit >= 0, 1).otherwise(0).alias("prediction"),
        p.alias("failure_probability"),
        F.round(F.lit(1.0) - p, digits).alias("normal_probability"),
    )
    out = out.select("*", rules.risk_band("failure_probability").alias("risk_level"),
                     *[v.alias(f"vote_{m}") for m, v in votes.items()])
    out = out.select("*", rules.ensemble_agreement([f"vote_{m}" for m in ensemble]).alias("ensemble_agreement"),
                     F.lit(chosen).alias("model_name"))
    return out


def align_features(df: DataFrame, feature_columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Project to the model schema; missing features become ``fill``."""
    present = set(df.columns)
    return df.select(*[F.col(c).cast("double").alias(c) if c in present else F.lit(float(fill)).alias(c)
                       for c in feature_columns])


def score_model(df: DataFrame, model, feature_columns: Sequence[str], prob_col: str = "probability",
                digits: int = 6) -> DataFrame:
    """M10 for a fitted Spark ML ``PipelineModel`` (assembler + scaler + classifier)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    p = F.round(vector_to_array(F.col(prob_col))[1], digits)
    out = scored.withColumn("failure_probability", p)
    out = out.withColumn("normal_probability", F.round(F.lit(1.0) - F.col("failure_probability"), digits))
    out = out.withColumn("prediction", F.col("prediction").cast("int"))
    out = out.withColumn("risk_level", rules.risk_band("failure_probability"))
    out = out.withColumn("maintenance_required", F.col("prediction") == 1)
    drop = [c for c in ("features", "scaled_features", "rawPrediction", prob_col) if c in out.columns]
    return out.drop(*drop)
