"""Churn classifiers: training, evaluation, importance and scoring."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.expr import count_if, one_row, safe_divide
from ..functions.ranks import value_ranks
from .boosting import HistogramBoosting

#: Training rows of a part, at least, where there are cores for more parts.
TRAIN_ROWS = 25_000


def with_balanced_weights(train: DataFrame, label: str = "churn") -> DataFrame:
    """Row weight n / (2 * rows of the label), as 'balanced' class weights."""
    s = one_row(train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")))
    d = train.withColumn("_s", s)
    w = F.when(F.col(label) == 1, F.col("_s.n") / (2 * F.col("_s.p"))).otherwise(F.col("_s.n") / (2 * (F.col("_s.n") - F.col("_s.p"))))
    return d.withColumn("weight", w).drop("_s")


def classifiers(cfg: Config = DEFAULT, trees: int = 200, boosts: int = 200) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": "churn", "weightCol": "weight"}
    seed = cfg.churn.seed
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000, **common),
        "Random Forest": RandomForestClassifier(
            numTrees=trees, maxDepth=15, minInstancesPerNode=5, seed=seed, cacheNodeIds=True, maxMemoryInMB=512, **common),
        "Gradient Boosting": HistogramBoosting(seed=seed, settings=json.dumps({"trees": boosts, "depth": 6, "rate": 0.1, "row_share": 0.8, "feature_share": 0.8}), **common),
    }


def pipeline(stage, features: list[str]) -> Pipeline:
    """Median fill and scaling fitted on the training rows, then the model."""
    filled = [f"{c}_filled" for c in features]
    return Pipeline(stages=[
        Imputer(strategy="median", relativeError=1e-4, inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw"),
        StandardScaler(withMean=True, inputCol="raw", outputCol="features"),
        stage,
    ])


def train_models(data: DataFrame, features: list[str], cfg: Config = DEFAULT, trees: int = 200, boosts: int = 200, names: list[str] | None = None) -> dict[str, PipelineModel]:
    """Fit the classifiers on the rows with is_train."""
    train = _dealt(with_balanced_weights(_doubles(data.where("is_train"), features))).persist()
    try:
        return {n: _plain(pipeline(m, features).fit(train)) for n, m in classifiers(cfg, trees, boosts).items() if names is None or n in names}
    finally:
        train.unpersist()


def _dealt(train: DataFrame) -> DataFrame:
    """``train`` in a part for each TRAIN_ROWS rows, but in no more parts than there are cores, as each part sums up every open node of a forest; Spark alone goes by bytes, and the rows are few but take long."""
    parts = min(-(-train.count() // TRAIN_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    return train.repartition(parts) if parts > train.rdd.getNumPartitions() else train


def _plain(model: PipelineModel) -> PipelineModel:
    """The model without its training summary: that holds the session, which cannot be sent to tasks once it has observed a metric."""
    last = model.stages[-1]
    if getattr(last, "hasSummary", False):
        last._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    def finite(c):
        v = F.col(c).cast("double")
        return F.when(F.abs(v) != float("inf"), v)

    return df.withColumns({c: finite(c) for c in features})


def score(model: PipelineModel, data: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """churn_prediction and churn_probability for every row."""
    out = model.transform(_doubles(data, features))
    return out.select(
        *(keep or [c for c in data.columns if c not in features] + [c for c in features]),
        F.col("prediction").cast("int").alias("churn_prediction"), vector_to_array("probability")[1].alias("churn_probability"))


def classification_metrics(scored: DataFrame, name: str, label: str = "churn") -> DataFrame:
    """One row: accuracy, precision, recall, F1, AUC, confusion counts and the other class's P/R/F1.

    AUC is the rank statistic of the scores, from counts per distinct score.
    """
    p, y = F.col("churn_prediction") == 1, F.col(label) == 1
    m = scored.agg(count_if(p & y).alias("tp"), count_if(p & ~y).alias("fp"), count_if(~p & y).alias("fn"), count_if(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    auc = roc_points(scored, label).agg(F.sum("area").alias("a")).scalar()
    f1 = lambda p, r: safe_divide(2 * p * r, p + r, 0.0)
    m = m.withColumns({
        "accuracy": safe_divide(tp + tn, tp + fp + fn + tn), "precision": safe_divide(tp, tp + fp, 0.0), "recall": safe_divide(tp, tp + fn, 0.0),
        "precision_0": safe_divide(tn, tn + fn, 0.0), "recall_0": safe_divide(tn, tn + fp, 0.0),
    }).withColumns({"f1": f1(F.col("precision"), F.col("recall")), "f1_0": f1(F.col("precision_0"), F.col("recall_0")), "roc_auc": auc})
    return m.select(F.lit(name).alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc", "tp", "fp", "fn", "tn", "precision_0", "recall_0", "f1_0")


def roc_points(scored: DataFrame, label: str = "churn", score: str = "churn_probability") -> DataFrame:
    """One ROC point per distinct score (predict churn at or above it), with the area of its step.

    Counts of rows and positives below each score come from value_ranks; nothing is sorted globally.
    """
    d = scored.select(score, F.col(label).cast("bigint").alias("p"))
    r = value_ranks(d, score, sums=["p"])
    tp, fp = F.col("p_total") - F.col("p_before"), F.col("total") - F.col("before") - (F.col("p_total") - F.col("p_before"))
    neg_total = F.col("total") - F.col("p_total")
    tpr, fpr = safe_divide(tp, F.col("p_total"), 0.0), safe_divide(fp, neg_total, 0.0)
    step_p, step_n = safe_divide(F.col("p"), F.col("p_total"), 0.0), safe_divide(F.col("n") - F.col("p"), neg_total, 0.0)
    return r.select(F.col(score).alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), ((tpr - step_p / 2) * step_n).alias("area"))


def compare_models(metrics: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Models by F1 with PASS or FAIL against the five metric floors."""
    c = cfg.churn
    floors = (("accuracy", c.min_accuracy), ("precision", c.min_precision), ("recall", c.min_recall), ("f1", c.min_f1), ("roc_auc", c.min_auc))
    m = metrics.withColumns({f"{n}_check": F.when(F.col(n) >= v, "PASS").otherwise("FAIL") for n, v in floors})
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "model"))).orderBy("rank")  # one row per model


def feature_importance(model: PipelineModel, features: list[str], name: str, spark) -> DataFrame:
    """Absolute coefficient or tree importance as percent of the sum, ranked, with the running share."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(name, f, abs(float(v))) for f, v in zip(features, values.toArray())]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    every, order = Window.partitionBy(F.lit(1)), Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    df = df.withColumn("importance_pct", safe_divide(F.col("importance") * 100, F.sum("importance").over(every), 0.0))
    return df.withColumn("rank", F.row_number().over(order)).withColumn(
        "cumulative_pct", F.sum("importance_pct").over(order.rowsBetween(Window.unboundedPreceding, 0))).orderBy("rank")


def evaluate_all(models: dict[str, PipelineModel], data: DataFrame, features: list[str]) -> DataFrame:
    out = None
    for name, m in models.items():
        row = classification_metrics(score(m, data, features, keep=["customer_id", "churn"]), name)
        out = row if out is None else out.unionByName(row)
    return out
