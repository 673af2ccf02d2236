"""Cost of a threshold pair, and the search for the best pair in one pass (THR1-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import Costs
from riskflow.functions.buckets import bucket
from riskflow.operators.metrics import score_groups


def linspace(start: float, stop: float, n: int) -> list[float]:
    if n == 1:
        return [start]
    step = (stop - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [stop]


def _cost_columns(cost: Costs, from_amounts: bool) -> dict[str, Column]:
    caught, missed = F.col("fraud_caught"), F.col("fraud_missed")
    prevented = F.col("amt_caught") if from_amounts else caught * cost.avg_fraud_loss
    lost = F.col("amt_missed") if from_amounts else missed * cost.avg_fraud_loss
    fp_cost, review = F.col("false_declines") * cost.false_positive, F.col("manual_reviews") * cost.manual_review
    return {
        "fraud_caught": caught,
        "fraud_missed": missed,
        "false_declines": F.col("false_declines"),
        "manual_reviews": F.col("manual_reviews"),
        "fraud_loss_prevented": prevented,
        "fraud_loss_missed": lost,
        "false_positive_cost": fp_cost,
        "review_cost": review,
        "total_cost": lost + fp_cost + review,
        "net_benefit": prevented - (lost + fp_cost + review),
    }


def cost_at(df: DataFrame, approve_below: float, block_from: float, cost: Costs = Costs(), from_amounts: bool = True, **cols: str) -> DataFrame:
    """THR1: one row for one pair of thresholds."""
    p = F.col("p")
    approve, block = p < approve_below, p >= block_from
    review = ~approve & (p < block_from)
    held = block | review

    def total(condition: Column, column: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))

    sums = score_groups(df, **cols).agg(
        total(held, "pos").alias("fraud_caught"),
        total(approve, "pos").alias("fraud_missed"),
        total(block, "neg").alias("false_declines"),
        (total(review, "pos") + total(review, "neg")).alias("manual_reviews"),
        total(held, "amt_pos").cast("double").alias("amt_caught"),
        total(approve, "amt_pos").cast("double").alias("amt_missed"),
    )
    return sums.select(
        F.lit(float(approve_below)).alias("approve_threshold"),
        F.lit(float(block_from)).alias("block_threshold"),
        *[c.alias(n) for n, c in _cost_columns(cost, from_amounts).items()],
    )


def cost_grid(df: DataFrame, n_steps: int = 50, cost: Costs = Costs(), from_amounts: bool = True, **cols: str) -> DataFrame:
    """Cost of every pair ``approve < block`` of the search grid.

    Rows are counted once, between neighbouring thresholds; everything after that
    works on at most 2·n_steps + 1 buckets.
    """
    approve, block = linspace(0.01, 0.5, n_steps), linspace(0.1, 0.95, n_steps)
    cuts = sorted(set(approve) | set(block))
    at = {t: i for i, t in enumerate(cuts)}
    buckets = (
        score_groups(df, **cols)
        .groupBy(bucket(F.col("p"), cuts).alias("bucket"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("amt_pos").alias("amt"))
    )
    below = F.col("bucket") <= F.col("cut")

    def split(column: str, inside: Column) -> Column:
        return F.sum(F.when(inside, F.col(column)).otherwise(0))

    sides = (
        buckets.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))))
        .groupBy("cut")
        .agg(
            split("pos", below).alias("pos_below"),
            split("pos", ~below).alias("pos_above"),
            split("neg", below).alias("neg_below"),
            split("neg", ~below).alias("neg_above"),
            F.sum(F.when(below, F.col("amt")).otherwise(0.0)).alias("amt_below"),
            F.sum(F.when(below, 0.0).otherwise(F.col("amt"))).alias("amt_above"),
        )
    )
    approve_cuts = F.array(*[F.struct(F.lit(at[t]).alias("cut"), F.lit(t).alias("t")) for t in approve])
    block_cuts = F.array(*[F.struct(F.lit(at[t]).alias("cut"), F.lit(t).alias("t")) for t in block])
    low = (
        sides.withColumn("_a", F.explode(approve_cuts))
        .where("cut = _a.cut")
        .select(
            F.col("_a.t").alias("approve_threshold"),
            *[F.col(c).alias(f"a_{c}") for c in ("pos_below", "pos_above", "neg_below", "amt_below", "amt_above")],
            F.explode(block_cuts).alias("_b"),
        )
        .where("_b.t > approve_threshold")
        .select("*", F.col("_b.cut").alias("cut"), F.col("_b.t").alias("block_threshold"))
        .drop("_b")
    )
    pairs = low.join(sides, "cut").select(
        "approve_threshold",
        "block_threshold",
        F.col("a_pos_above").alias("fraud_caught"),
        F.col("a_pos_below").alias("fraud_missed"),
        F.col("neg_above").alias("false_declines"),
        (F.col("pos_below") + F.col("neg_below") - F.col("a_pos_below") - F.col("a_neg_below")).alias("manual_reviews"),
        F.col("a_amt_above").alias("amt_caught"),
        F.col("a_amt_below").alias("amt_missed"),
    )
    return pairs.select("approve_threshold", "block_threshold", *[c.alias(n) for n, c in _cost_columns(cost, from_amounts).items()])


def best_thresholds(df: DataFrame, n_steps: int = 50, cost: Costs = Costs(), from_amounts: bool = True, **cols: str) -> DataFrame:
    """THR2: the pair with the highest net benefit; the smallest pair among equals."""
    grid = cost_grid(df, n_steps, cost, from_amounts, **cols)
    return grid.orderBy(F.col("net_benefit").desc(), "approve_threshold", "block_threshold").limit(1)
