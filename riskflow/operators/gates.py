"""Promotion gates and the retrain trigger (GAT1-2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import GateLimits, RetrainLimits
from riskflow.operators.drift import drift_summary
from riskflow.schema import FORBIDDEN


def _gate(name: str, value: Column, op: str, limit: float | None, ok: Column) -> Column:
    return F.struct(
        F.lit(name).alias("gate"),
        value.cast("double").alias("value"),
        F.lit(op).alias("op"),
        F.lit(limit).cast("double").alias("limit"),
        F.coalesce(ok, F.lit(False)).alias("passed"),
    )


def promotion_gates(
    metrics: DataFrame,
    has_calibration: bool = True,
    has_drift: bool = False,
    has_leakage: bool = False,
    limits: GateLimits = GateLimits(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """GAT1: rows ``(gate, value, op, limit, passed)`` for each row of metrics
    (``pr_auc, recall, false_positive_rate, brier, total_expected_cost``)."""

    def at_least(name: str, column: str, limit: float) -> Column:
        return _gate(name, F.col(column), ">=", limit, F.col(column) >= limit)

    def at_most(name: str, column: str, limit: float) -> Column:
        return _gate(name, F.col(column), "<=", limit, F.col(column) <= limit)

    gates = [
        at_least("pr_auc", "pr_auc", limits.min_pr_auc),
        at_least("recall", "recall", limits.min_recall),
        at_most("false_positive_rate", "false_positive_rate", limits.max_fpr),
        at_most("brier", "brier", limits.max_brier),
        at_most("expected_cost", "total_expected_cost", limits.max_expected_cost),
    ]
    required = [
        ("calibration", limits.require_calibration, has_calibration),
        ("drift", limits.require_no_drift, not has_drift),
        ("leakage", limits.require_no_leakage, not has_leakage),
    ]
    gates += [_gate(n, F.lit(float(ok)), "=", 1.0, F.lit(ok)) for n, wanted, ok in required if wanted]
    return metrics.select(*keep, F.explode(F.array(*gates)).alias("g")).select(*keep, "g.*")


def promotion_evidence(calibration: DataFrame, drift: DataFrame, features: Sequence[str]) -> dict[str, bool]:
    """The last three gates' questions answered by results, as arguments of :func:`promotion_gates`.

    ``calibration`` has one row per method (``method, brier``; ``raw`` among them), ``drift`` the rows of a drift check.
    """
    brier = {r["method"]: r["brier"] for r in calibration.select("method", "brier").collect()}
    raw = brier.pop("raw", float("inf"))
    return {
        "has_calibration": any(b < raw for b in brier.values()),
        "has_drift": drift_summary(drift).first()["drift_detected"],
        "has_leakage": bool(set(features) & set(FORBIDDEN)),
    }


def promotion_decision(gates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Approved only when every gate passes; the reason names those that did not."""
    failed = F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), "; ")
    return gates.groupBy(*keys).agg(
        F.every("passed").alias("approved"),
        F.count_if("passed").alias("n_passed"),
        F.count_if(~F.col("passed")).alias("n_failed"),
        failed.alias("_failed"),
    ).select(
        *keys,
        "approved",
        "n_passed",
        "n_failed",
        F.when(F.col("approved"), "APPROVED").otherwise(F.concat(F.lit("REJECTED: "), F.col("_failed"))).alias("reason"),
    )


def retrain_trigger(current: DataFrame, baseline: DataFrame, drift_detected: bool = False, limits: RetrainLimits = RetrainLimits()) -> DataFrame:
    """GAT2: retrain on a clear loss, or on a smaller loss together with drift; never on drift alone."""
    both = (
        current.select("pr_auc", "recall", F.lit(1).alias("_one"))
        .join(baseline.select(F.col("pr_auc").alias("b_pr_auc"), F.col("recall").alias("b_recall"), F.lit(1).alias("_one")), "_one")
        .select((F.col("b_pr_auc") - F.col("pr_auc")).alias("pr_auc_drop"), (F.col("b_recall") - F.col("recall")).alias("recall_drop"))
    )
    ap, rec = F.col("pr_auc_drop"), F.col("recall_drop")
    with_drift = F.lit(drift_detected) & ((ap > limits.drift_pr_auc_drop) | (rec > limits.drift_recall_drop))
    reason = (
        F.when(ap > limits.pr_auc_drop, "pr_auc").when(rec > limits.recall_drop, "recall").when(with_drift, "drift").otherwise("none")
    )
    return both.select("pr_auc_drop", "recall_drop", F.lit(drift_detected).alias("drift_detected"), (reason != "none").alias("retrain"), reason.alias("reason"))
