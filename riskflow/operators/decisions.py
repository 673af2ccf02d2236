"""Scores, levels and decisions (DEC1-7), as column expressions over a probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import RiskBands


def risk_score(p: Column, bands: RiskBands = RiskBands()) -> Column:
    """The root spreads small probabilities over the scale; the fraction is cut, not rounded."""
    clipped = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
    return F.least((F.sqrt(clipped) * bands.max_score).cast("int"), F.lit(bands.max_score))


def risk_level(score: Column, bands: RiskBands = RiskBands()) -> Column:
    return (
        F.when(score <= bands.low_max, "LOW")
        .when(score <= bands.medium_max, "MEDIUM")
        .when(score <= bands.high_max, "HIGH")
        .otherwise("CRITICAL")
    )


def decision_by_score(score: Column, bands: RiskBands = RiskBands()) -> Column:
    return F.when(score <= bands.approve_max, "APPROVE").when(score <= bands.review_max, "REVIEW").otherwise("BLOCK")


def decision_by_threshold(p: Column, approve_below: float | Column, block_from: float | Column) -> Column:
    return F.when(p < approve_below, "APPROVE").when(p < block_from, "REVIEW").otherwise("BLOCK")


def decide(df: DataFrame, p: str = "p", error: str | None = None, bands: RiskBands = RiskBands(), approve_below: float | None = None, block_from: float | None = None) -> DataFrame:
    """Add probability, score, level and decision to a table.

    Rows whose ``error`` column is set, or without a probability, are never approved:
    probability and score 0, level UNKNOWN, decision REVIEW. Both thresholds together
    select the probability policy instead of the score cut-offs.
    """
    failed = F.col(p).isNull() | F.isnan(p)
    if error:
        failed = failed | F.col(error).isNotNull()
    prob = F.when(failed, F.lit(0.0)).otherwise(F.col(p).cast("double"))
    score = risk_score(prob, bands)
    policy = decision_by_score(score, bands)
    if approve_below is not None and block_from is not None:
        policy = decision_by_threshold(prob, approve_below, block_from)
    return df.select(
        "*",
        prob.alias("fraud_probability"),
        score.alias("risk_score"),
        F.when(failed, "UNKNOWN").otherwise(risk_level(score, bands)).alias("risk_level"),
        F.when(failed, "REVIEW").otherwise(policy).alias("decision"),
    )


def out_of_bounds(df: DataFrame, bands: RiskBands = RiskBands()) -> DataFrame:
    """QLT12: rows whose probability or score leaves its range; must be empty."""
    p, s = F.col("fraud_probability"), F.col("risk_score")
    ok = p.between(0.0, 1.0) & ~F.isnan(p) & s.between(0, bands.max_score)
    return df.where(~F.coalesce(ok, F.lit(False)))
