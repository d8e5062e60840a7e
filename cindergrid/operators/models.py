"""Spark ML baselines with one contract: features in, event probability out."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.probability import intensity_to_probability

# Fixed value: fit weight of positives in the rate model.
POISSON_POSITIVE_WEIGHT = 4.0


def _stages(numeric, categories):
    filled = [f"_n_{c}" for c in numeric]
    coded = [f"_c_{c}" for c in categories]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled)]
    if categories:
        stages.append(
            StringIndexer(inputCols=list(categories), outputCols=coded, handleInvalid="keep")
        )
    stages.append(VectorAssembler(inputCols=[*filled, *coded], outputCol="_features"))
    return stages


def _ready(df, numeric, label, weight):
    out = df.withColumns({c: F.col(c).cast("double") for c in numeric})
    if label in df.columns:
        out = out.withColumn("_label", F.col(label).cast("double"))
    w = F.col(weight).cast("double") if weight and weight in df.columns else F.lit(1.0)
    return out.withColumn("_weight", w)


class EventModel:
    """A fitted pipeline that adds a probability column."""

    def __init__(self, pipeline, numeric, kind):
        self.pipeline, self.numeric, self.kind = pipeline, list(numeric), kind

    def score(self, df, out="prob_raw") -> DataFrame:
        scored = self.pipeline.transform(_ready(df, self.numeric, "", None))
        if self.kind == "rate":
            value = intensity_to_probability("prediction")
        else:
            value = vector_to_array(F.col("probability"))[1]
        return scored.select(*df.columns, value.alias(out))


def _fit(estimator, df, numeric, categories, label, weight, kind="class"):
    data = _ready(df, numeric, label, weight)
    return EventModel(
        Pipeline(stages=[*_stages(numeric, categories), estimator]).fit(data), numeric, kind
    )


def fit_logistic(df, numeric, categories=(), label="is_fire", weight=None, reg=0.0) -> EventModel:
    est = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", regParam=reg, maxIter=50
    )
    return _fit(est, df, numeric, categories, label, weight)


def fit_poisson(df, numeric, categories=(), label="is_fire", weight=None) -> EventModel:
    """Event-rate model; positives weigh more in the fit."""
    boost = F.when(F.col(label) > 0, POISSON_POSITIVE_WEIGHT).otherwise(1.0)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    est = GeneralizedLinearRegression(
        family="poisson", link="log", featuresCol="_features", labelCol="_label",
        weightCol="_weight", maxIter=25, regParam=1e-6,
    )
    return _fit(est, df.withColumn("_pw", w * boost), numeric, categories, label, "_pw", "rate")


def fit_forest(df, numeric, categories=(), label="is_fire", weight=None, trees=20, depth=6, seed=42):
    est = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", numTrees=trees,
        maxDepth=depth, seed=seed, maxBins=64,
    )
    return _fit(est, df, numeric, categories, label, weight)


def fit_boosted(df, numeric, categories=(), label="is_fire", weight=None, rounds=8, depth=4, seed=42):
    est = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=rounds,
        maxDepth=depth, seed=seed, maxBins=64,
    )
    return _fit(est, df, numeric, categories, label, weight)
