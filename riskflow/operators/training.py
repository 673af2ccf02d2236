"""Model fitting with spark.ml (TRN1-8)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import checkpoint_dir


class IncompatibleModelError(ValueError):
    """The features offered are not the ones the model was fitted on."""


def schema_hash(features: Sequence[str]) -> str:
    """TRN8: a short digest of feature names and their order."""
    return hashlib.sha256(",".join(features).encode("utf-8")).hexdigest()[:16]


@dataclass
class FittedModel:
    name: str
    model: PipelineModel
    features: list[str]
    version: str = "v1"
    digest: str = ""

    def __post_init__(self) -> None:
        self.digest = self.digest or schema_hash(self.features)

    def verify(self, columns: Sequence[str] | None = None) -> None:
        """One comparison: the digest of the offered columns (by default the own list) is the one taken at fitting."""
        offered = list(self.features if columns is None else columns)
        if offered and schema_hash(offered) == self.digest:
            return
        at = next((i for i, (a, b) in enumerate(zip(offered, self.features)) if a != b), min(len(offered), len(self.features)))
        raise IncompatibleModelError(
            f"{self.name} {self.version} was fitted on {len(self.features)} features (digest {self.digest}); "
            f"{len(offered)} were offered, which differ from place {at} on: {offered[at:at + 3]}"
        )

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        """TRN7: add the probability of the positive class."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise IncompatibleModelError(f"missing features: {missing[:5]}")
        columns = [c for c in df.columns if c != out]
        return self.model.transform(df).select(*columns, vector_to_array("probability")[1].alias(out))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        about = json.dumps({"name": self.name, "features": self.features, "version": self.version, "digest": self.digest})
        SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        fitted = cls(about["name"], PipelineModel.load(f"{path}/model"), about["features"], about["version"], about["digest"])
        fitted.verify()
        return fitted


def class_counts(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).first()
    return row["neg"], row["pos"]


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "true_fraud_label", c: float = 0.1, max_iter: int = 1000, name: str = "logistic_basic") -> FittedModel:
    """TRN1, TRN2: standardise on training rows, then a class-balanced logistic regression."""
    neg, pos = class_counts(train, label)
    n = neg + pos
    weight = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(neg, 1)))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * n), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter, tol=1e-7,
        ),
    ]
    return FittedModel(name, Pipeline(stages=stages).fit(train.withColumn("_weight", weight)), list(features))


def fit_boosted(
    train: DataFrame,
    validation: DataFrame,
    features: Sequence[str],
    label: str = "true_fraud_label",
    rounds: int = 300,
    depth: int = 6,
    step: float = 0.05,
    column_share: float = 0.8,
    seed: int = 42,
    name: str = "boosted_basic",
) -> FittedModel:
    """TRN3, TRN4: boosted trees; positives weigh neg/pos, validation rows stop the rounds early."""
    checkpoint_dir(train.sparkSession)  # long tree lineages are cut there
    neg, pos = class_counts(train, label)
    weight = F.when(F.col(label) == 1, neg / max(pos, 1)).otherwise(1.0)
    rows = (
        train.withColumn("_validation", F.lit(False))
        .unionByName(validation.withColumn("_validation", F.lit(True)))
        .withColumn("_weight", weight)
    )
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        GBTClassifier(
            featuresCol="features", labelCol=label, weightCol="_weight", validationIndicatorCol="_validation",
            validationTol=0.001, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8,
            featureSubsetStrategy=str(column_share), minInstancesPerNode=5, seed=seed, checkpointInterval=10,
            maxMemoryInMB=512,
        ),
    ]
    return FittedModel(name, Pipeline(stages=stages).fit(rows), list(features))


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "true_fraud_label", trees: int = 500, depth: int = 7, seed: int = 42, name: str = "forest_engineered") -> FittedModel:
    """TRN5: a second tree family, with balanced class weights."""
    neg, pos = class_counts(train, label)
    weight = F.when(F.col(label) == 1, neg / max(pos, 1)).otherwise(1.0)
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="features"),
        RandomForestClassifier(
            featuresCol="features", labelCol=label, weightCol="_weight", numTrees=trees, maxDepth=depth,
            subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=20, seed=seed, maxMemoryInMB=512,
        ),
    ]
    return FittedModel(name, Pipeline(stages=stages).fit(train.withColumn("_weight", weight)), list(features))


def select_best(experiments: DataFrame, metric: str = "val_pr_auc") -> DataFrame:
    """TRN6: the experiment with the highest validation metric."""
    return experiments.orderBy(F.col(metric).desc(), "model").limit(1)
