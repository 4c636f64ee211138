"""Model training with Spark ML (M1-M9).

* Scaling (M1) uses the *population* std of the training part (zero variance
  -> scale 1), computed as one aggregate and applied with a one-row broadcast;
  ``ml.feature.StandardScaler`` uses the sample std, so it is not used.
* Class weights (M2) are a column derived from two counts.
* A Spark ML fit is one ``Pipeline`` (assembler + classifier) trained on the
  distributed frame; forests and boosted trees are ``forest`` and ``boosting``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import cleaning, features, metrics, ordering
from ..session import scratch_path
from . import boosting, forest, scoring
from .boosting import BoostedModel, Settings
from .forest import ForestModel

LABEL = "machine_failure"
SEED = 42

# The reference's model settings and search space.
GBT_A = Settings(rounds=200, max_depth=6, rate=0.1, row_share=0.8, column_share=0.8, seed=42)
GBT_B = Settings(rounds=200, max_depth=6, rate=0.1, row_share=0.8, column_share=0.8, seed=42,
                 penalty=0.0, min_child_weight=1e-3, min_child_rows=20, max_leaves=31)
SPARK_GBT = {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
RF = {"numTrees": 200, "maxDepth": 30}
FOREST = forest.Settings(trees=200, max_depth=30, max_bins=32, seed=42)
LR = {"maxIter": 1000}
SEARCH_SPACE = {
    "max_depth": (3, 10, "int"),
    "learning_rate": (0.01, 0.3, "log"),
    "n_estimators": (100, 500, "int"),
    "subsample": (0.6, 1.0, "float"),
    "colsample_bytree": (0.6, 1.0, "float"),
    "min_child_weight": (1, 10, "int"),
    "gamma": (0.0, 5.0, "float"),
    "scale_pos_weight": (5, 50, "float"),
}


@dataclass
class TrainingData:
    train: DataFrame
    test: DataFrame
    feature_columns: list = field(default_factory=list)


def training_frame(sensors: DataFrame, mode: str = "auto") -> DataFrame:
    """Cleaned sensors -> 16 model features (+ label, order keys)."""
    with_type = cleaning.one_hot(sensors, "type", prefix="Type")
    return features.feature_pipeline(with_type, mode=mode)


def time_split(df: DataFrame, test_size: float = 0.2, order_by=("ts", "event_id")) -> tuple[DataFrame, DataFrame]:
    """T7 on the feature table: earliest (1 - test_size) share trains."""
    tagged = ordering.time_split(df, list(order_by), test_size)
    return (tagged.filter(F.col("split") == "train").drop("split"),
            tagged.filter(F.col("split") == "test").drop("split"))


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """M1: one-row frame of mean / population std (std 0 -> 1) per column."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    stats = train.agg(*aggs)
    return stats.select(*[x for c in columns for x in (
        F.col(f"mu_{c}"), F.when(F.col(f"sd_{c}") > 0, F.col(f"sd_{c}")).otherwise(F.lit(1.0)).alias(f"sd_{c}"))])


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    j = df.crossJoin(F.broadcast(scaler))  # one row
    out = j.select(*[((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).alias(c) if c in columns else F.col(c)
                     for c in df.columns])
    return out


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M2: balanced weights n / (2 · n_class)."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return counts.crossJoin(F.broadcast(total)).select(
        "class", "count", (F.col("_n") / (F.lit(2.0) * F.col("count"))).alias("weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = LABEL, col: str = "weight") -> DataFrame:
    w = weights.select(F.col("class").alias(label), F.col("weight").alias(col))
    return df.join(F.broadcast(w), label, "left")  # two rows


def with_pos_weight(df: DataFrame, label: str = LABEL, col: str = "weight") -> DataFrame:
    """Positive class weight = negatives / max(positives, 1) (boosted trees)."""
    r = df.agg((F.count_if(F.col(label) == 0) / F.greatest(F.count_if(F.col(label) == 1), F.lit(1))).alias("_w"))
    j = df.crossJoin(F.broadcast(r))
    return j.withColumn(col, F.when(F.col(label) == 1, F.col("_w")).otherwise(F.lit(1.0))).drop("_w")


def _estimator(kind: str, params: dict, weight_col: str | None):
    common = {"featuresCol": "features", "labelCol": LABEL}
    if weight_col:
        common["weightCol"] = weight_col
    if kind == "lr":
        return LogisticRegression(**common, **params)
    if kind == "rf":
        return RandomForestClassifier(**common, seed=SEED, **params)
    if kind == "gbt":
        return GBTClassifier(**common, seed=SEED, **params)
    raise ValueError(kind)


def fit(train: DataFrame, feature_columns: Sequence[str], kind: str, params: dict | None = None,
        weight_col: str | None = "weight") -> PipelineModel:
    """M3 (and Spark ML's own forest and boosted trees): assembler + classifier pipeline fitted on the distributed frame.

    The forest M4 of full depth is ``fit_forest``, the boosted models M5 and M6 are ``fit_boosted_pair``.
    """
    defaults = {"lr": LR, "rf": RF, "gbt": SPARK_GBT}[kind]
    params = {**defaults, **(params or {})}
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(feature_columns), outputCol="features",
                                            handleInvalid="keep"),
                            _estimator(kind, params, weight_col)])
    return pipe.fit(train)


def evaluate(model: PipelineModel, test: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """PR-AUC, AP and F1 of a fitted model on the test part (exact curve, distributed)."""
    scored = scoring.score_model(test, model, feature_columns)
    return metrics.pr_summary(scored).crossJoin(metrics.classification_metrics(scored).select("precision", "recall",
                                                                                              "f1"))


def save_model(model: PipelineModel, path: str | None = None, spark=None, name: str = "model") -> str:
    """M8: persist a fitted pipeline (Spark ML format) under the shared folder."""
    path = path or scratch_path(spark, name)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def pos_weight(df: DataFrame, label: str = LABEL) -> float:
    """A19 as a number: negatives / max(positives, 1)."""
    r = df.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    return r["n"] / max(r["p"], 1) if r["n"] else 1.0


def fit_boosted_pair(train: DataFrame, feature_columns: Sequence[str], kinds: Sequence[str] = ("gbt", "gbt_b")) -> dict[str, BoostedModel]:
    """M5 (by depth) and M6 (best leaf first), positives weighted; both share their scans."""
    weight = pos_weight(train)
    settings = [replace({"gbt": GBT_A, "gbt_b": GBT_B}[k], pos_weight=weight) for k in kinds]
    return dict(zip(kinds, boosting.fit_boosted(train, feature_columns, settings)))


def fit_forest(train: DataFrame, feature_columns: Sequence[str]) -> ForestModel:
    """M4: the forest with balanced classes."""
    weight = {r["class"]: r["weight"] for r in class_weights(train).collect()}        # two rows
    return forest.fit_forest(train, feature_columns, replace(FOREST, weights=(weight.get(0, 1.0), weight.get(1, 1.0))))


def evaluate_forest(model: ForestModel, test: DataFrame) -> DataFrame:
    """PR-AUC, AP, precision, recall and F1 of a forest on the test part."""
    scored = forest.score_forest(test.select(LABEL, *model.features), {"m": model}).withColumnRenamed("p_m", "failure_probability").withColumnRenamed("vote_m", "prediction")
    return metrics.pr_summary(scored).crossJoin(metrics.classification_metrics(scored).select("precision", "recall", "f1"))


def boosted_scores(df: DataFrame, models: dict[str, BoostedModel]) -> DataFrame:
    return boosting.score_boosted(df, models)


def dealt(df: DataFrame) -> DataFrame:
    """Rows spread over all tasks: a later part in the order of time lies in few of them."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, ordering.default_chunks(df)))


def evaluate_boosted(model: BoostedModel, test: DataFrame) -> DataFrame:
    """PR-AUC, AP, precision, recall and F1 of a boosted model on the test part, whose scores are written once."""
    scores = boosted_scores(dealt(test.select(LABEL, *model.features)), {"m": model}).select(
        LABEL, F.col("p_m").alias("failure_probability"), (F.col("margin_m") >= 0).cast("int").alias("prediction"))
    path = scratch_path(test.sparkSession, "boosted-scores")
    scores.write.parquet(path)
    scored = test.sparkSession.read.schema(scores.schema).parquet(path)
    return metrics.pr_summary(scored).crossJoin(metrics.classification_metrics(scored).select("precision", "recall", "f1"))


NODE = "tree int, node int, feature int, threshold double, bin int, left int, right int, value double, cover double"


def save_boosted(spark, model: BoostedModel, path: str | None = None) -> str:
    """M8 for boosted trees: one row per node, and the settings as JSON."""
    path = path or scratch_path(spark, "boosted-model")
    rows = [(i, n, *(t.__dict__[c][n].item() for c in ("feature", "threshold", "bin", "left", "right", "value", "cover")))
            for i, t in enumerate(model.trees) for n in range(len(t.feature))]
    spark.createDataFrame(rows, NODE).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = json.dumps({"features": list(model.features), "settings": asdict(model.settings)})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def load_boosted(spark, path: str) -> BoostedModel:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    kinds = {"feature": np.int32, "threshold": float, "bin": np.int32, "left": np.int32, "right": np.int32, "value": float, "cover": float}
    trees = [boosting.Tree(**{c: part[c].to_numpy(k) for c, k in kinds.items()}) for _, part in nodes.groupby("tree", sort=True)]
    return BoostedModel(tuple(about["features"]), Settings(**about["settings"]), trees)


def to_settings(cfg: dict, seed: int = SEED) -> Settings:
    """A search configuration as settings of the boosted trees."""
    return Settings(rounds=int(cfg["n_estimators"]), max_depth=int(cfg["max_depth"]), rate=float(cfg["learning_rate"]), row_share=float(cfg["subsample"]),
                    column_share=float(cfg["colsample_bytree"]), min_child_weight=float(cfg["min_child_weight"]), gamma=float(cfg["gamma"]),
                    pos_weight=float(cfg["scale_pos_weight"]), seed=seed)


TRIAL_BINS = 64


def trial_scores(valid: DataFrame, models: dict[int, BoostedModel], label: str = LABEL) -> dict[int, float]:
    """PR-AUC of every trial on the same rows: one scoring pass, one grouped curve.

    Scores have six digits, so a trial's curve has at most a million points, whatever the rows are.
    """
    scored = boosted_scores(dealt(valid.select(label, *next(iter(models.values())).features)), {str(k): m for k, m in models.items()})
    pairs = ", ".join(f"{k}, p_{k}" for k in models)
    points = (scored.selectExpr(label, f"stack({len(models)}, {pairs}) AS (trial, score)").groupBy("trial", "score")
              .agg(F.count_if(F.col(label) == 1).alias("tp"), F.count(F.lit(1)).alias("n")))
    down = Window.partitionBy("trial").orderBy(F.desc("score"))
    run = points.select("trial", "score", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"),
                        F.sum("tp").over(Window.partitionBy("trial")).alias("all"))
    run = run.select("trial", "score", (F.col("tp") / F.greatest("all", F.lit(1))).alias("recall"), (F.col("tp") / F.col("n")).alias("precision"))
    run = run.select("trial", "recall", "precision", F.lag("recall", 1, 0.0).over(down).alias("r0"), F.lag("precision", 1, 1.0).over(down).alias("p0"))
    area = run.groupBy("trial").agg(F.sum((F.col("recall") - F.col("r0")) * (F.col("precision") + F.col("p0")) / 2).alias("a"))
    return {r["trial"]: float(r["a"]) for r in area.collect()}


def tune(train: DataFrame, valid: DataFrame, feature_columns: Sequence[str], n_trials: int = 50, seed: int = SEED,
         space: dict | None = None, generation: int = 10) -> DataFrame:
    """M9: one row per trial with its settings and its PR-AUC on the time-later part.

    A generation of trials is fitted on shared scans; the next one is drawn by the ratio of the
    densities of good and bad trials (``boosting.suggest``).  ``space`` replaces ``SEARCH_SPACE``
    (same names, other ranges).
    """
    space = space or SEARCH_SPACE
    rng = np.random.Generator(np.random.PCG64(seed))
    history: list[tuple[dict, float]] = []
    ready = boosting.prepared(train, feature_columns, max_bins=TRIAL_BINS)
    while len(history) < n_trials:
        drawn = boosting.suggest(history, space, min(generation, n_trials - len(history)), rng)
        models = boosting.fit_boosted(train, feature_columns, [to_settings(c, seed) for c in drawn], max_bins=TRIAL_BINS, ready=ready)
        area = trial_scores(valid, dict(enumerate(models)))
        history += [(c, area.get(i, 0.0)) for i, c in enumerate(drawn)]
    rows = [(i, score, *[float(cfg[k]) for k in SEARCH_SPACE]) for i, (cfg, score) in enumerate(history)]
    return train.sparkSession.createDataFrame(rows, "trial int, pr_auc double, " + ", ".join(f"{k} double" for k in SEARCH_SPACE))
