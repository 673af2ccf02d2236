"""Probability calibration with spark.ml, and its evaluation (CAL1-6)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.functions.buckets import bucket

N_BINS = 10


def bin_edges(n_bins: int = N_BINS) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def score_quality(df: DataFrame, methods: Sequence[str], y: str = "y", n_bins: int = N_BINS) -> DataFrame:
    """MET7 and CAL4 for several probability columns: rows ``(method, brier, ece, n)``.

    Bins are left-closed, the last one closed on both sides; one pass for all columns.
    """
    q, label = F.col("q"), F.col("y")
    inside = q.between(0.0, 1.0)
    bins = (
        df.select(F.col(y).cast("double").alias("y"), *[F.col(m).cast("double").alias(m) for m in methods])
        .unpivot(["y"], list(methods), "method", "q")
        .groupBy("method", F.when(inside, bucket(q, bin_edges(n_bins)[1:-1])).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("y").alias("sum_y"),
            F.sum("q").alias("sum_q"),
            F.sum((q - label) * (q - label)).alias("sum_sq"),
        )
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("sum_y") - F.col("sum_q"))).otherwise(0.0)
    return bins.groupBy("method").agg(
        (F.sum("sum_sq") / F.sum("n")).alias("brier"),
        (F.sum(gap) / F.sum("n")).alias("ece"),
        F.sum("n").alias("n"),
    )


@dataclass
class Calibrator:
    """Fitted calibrations of a raw probability; ``active`` is the one scoring uses."""

    slope: float | None = None
    intercept: float | None = None
    isotonic: IsotonicRegressionModel | None = None
    active: str = "platt"

    @classmethod
    def fit(cls, df: DataFrame, y: str = "y", p: str = "p") -> Calibrator:
        """CAL1, CAL2 on the calibration split; equal scores are merged before the fit."""
        merged = (
            df.groupBy(F.col(p).cast("double").alias("raw"))
            .agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).cast("double").alias("n"))
            .persist()
        )
        rows = (
            merged.select("raw", F.explode(F.array(
                F.struct(F.lit(1.0).alias("y"), (F.col("rate") * F.col("n")).alias("w")),
                F.struct(F.lit(0.0).alias("y"), ((1.0 - F.col("rate")) * F.col("n")).alias("w")),
            )).alias("_c"))
            .select("raw", "_c.y", "_c.w")
            .where("w > 0")
        )
        total = merged.agg(F.sum("n")).first()[0]
        # The penalty is stated per summed loss; spark.ml averages the loss over rows.
        platt = LogisticRegression(
            featuresCol="features", labelCol="y", weightCol="w", regParam=1.0 / total, elasticNetParam=0.0,
            standardization=False, maxIter=1000, tol=1e-9,
        ).fit(VectorAssembler(inputCols=["raw"], outputCol="features").transform(rows))
        isotonic = IsotonicRegression(featuresCol="raw", labelCol="rate", weightCol="n", predictionCol="isotonic").fit(merged)
        merged.unpersist()
        return cls(float(platt.coefficients[0]), float(platt.intercept), isotonic)

    def platt(self, p: Column) -> Column:
        if self.slope is None:
            raise ValueError("Platt scaling is not fitted")
        return 1.0 / (1.0 + F.exp(-(p * self.slope + self.intercept)))

    def transform(self, df: DataFrame, p: str = "p", out: str = "calibrated", method: str | None = None) -> DataFrame:
        """CAL3."""
        method = method or self.active
        if method == "platt":
            return df.withColumn(out, self.platt(F.col(p).cast("double")))
        if method == "isotonic":
            if self.isotonic is None:
                raise ValueError("isotonic calibration is not fitted")
            columns = df.columns
            scored = self.isotonic.transform(df.withColumn("raw", F.col(p).cast("double")))
            return scored.select(*columns, F.greatest(F.least(F.col("isotonic"), F.lit(1.0)), F.lit(0.0)).alias(out))
        raise ValueError(f"unknown calibration method: {method}")

    def evaluate(self, df: DataFrame, y: str = "y", p: str = "p", n_bins: int = N_BINS) -> DataFrame:
        """CAL5: Brier and ECE of the raw and the calibrated probabilities on unseen rows."""
        both = self.transform(self.transform(df.select(F.col(y).alias("y"), F.col(p).alias("raw_p")), "raw_p", "platt", "platt"), "raw_p", "isotonic_p", "isotonic")
        named = both.select("y", F.col("raw_p").alias("raw"), "platt", F.col("isotonic_p").alias("isotonic"))
        return score_quality(named, ["raw", "platt", "isotonic"], "y", n_bins)

    def choose(self, evaluation: DataFrame) -> str:
        """CAL6: the calibration with the lowest Brier score becomes active."""
        best = evaluation.where(F.col("method") != "raw").orderBy("brier", F.col("method").desc()).first()
        self.active = best["method"]
        return self.active
