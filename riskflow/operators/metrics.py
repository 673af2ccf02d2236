"""Classification metrics (MET1-11).

Everything starts from one partial aggregate per distinct score, so the ordered part
works on distinct scores and never on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.config import CURVE_THRESHOLDS, Costs
from riskflow.functions.buckets import bucket
from riskflow.functions.prefix import ordered_totals


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_groups(df: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", amount: str | None = "amount") -> DataFrame:
    """``(keys, p, pos, neg, amt_pos)`` with one row per distinct score."""
    fraud = F.col(y) == 1
    amt = F.when(fraud, F.col(amount)).otherwise(0.0) if amount else F.lit(0.0)
    return df.groupBy(*keys, F.col(p).cast("double").alias("p")).agg(
        F.sum(fraud.cast("bigint")).alias("pos"),
        F.sum((~fraud).cast("bigint")).alias("neg"),
        F.sum(amt).alias("amt_pos"),
    )


def _ordered(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ordered_totals(groups, keys, "p", ["pos", "neg"], descending=True)


def _auc_terms() -> tuple[Column, Column]:
    """Terms over the score-descending order whose sums are ROC-AUC and average precision."""
    pos, neg, tp, fp = F.col("pos"), F.col("neg"), F.col("pos_before"), F.col("neg_before")
    all_pos, all_neg = F.col("pos_total"), F.col("neg_total")
    lower = all_neg - fp - neg
    roc = pos * (lower + neg / 2.0) / (all_pos.cast("double") * all_neg)
    step = (pos / all_pos) * ((tp + pos) / (tp + pos + fp + neg))
    two_classes = (all_pos > 0) & (all_neg > 0)
    return F.when(two_classes, roc).otherwise(0.0), F.when(two_classes, step).otherwise(0.0)


def ranking(df: DataFrame, keys: Sequence[str] = (), **cols: str) -> DataFrame:
    """MET4-6: ROC-AUC (ties count half), average precision, prevalence and lift."""
    roc, step = _auc_terms()
    out = _ordered(score_groups(df, keys, **cols), keys).groupBy(*keys).agg(
        F.sum(roc).alias("roc_auc"),
        F.sum(step).alias("pr_auc"),
        ratio(F.sum("pos"), F.sum(F.col("pos") + F.col("neg"))).alias("prevalence"),
    )
    return out.withColumn("pr_auc_lift", ratio(F.col("pr_auc"), F.col("prevalence")))


def rate_columns(cost: Costs = Costs(), from_amounts: bool = True) -> dict[str, Column]:
    """MET2, 3, 9, 10 as expressions of ``tp fp tn fn`` (and ``amt_caught amt_missed``)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    caught = F.col("amt_caught") if from_amounts else tp * cost.avg_fraud_loss
    missed = F.col("amt_missed") if from_amounts else fn * cost.avg_fraud_loss
    fp_cost = fp * cost.false_positive
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
        "specificity": ratio(tn, tn + fp),
        "false_positive_rate": ratio(fp, tn + fp),
        "fraud_loss_prevented": caught,
        "fraud_loss_missed": missed,
        "false_positive_cost": fp_cost,
        "total_expected_cost": missed + fp_cost,
        "net_benefit": caught - missed - fp_cost,
    }


def _confusion_aggregates(threshold: float | Column) -> list[Column]:
    hit = F.col("p") >= threshold
    return [
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, F.col("amt_pos")).otherwise(0.0)).alias("amt_caught"),
        F.sum(F.when(hit, 0.0).otherwise(F.col("amt_pos"))).alias("amt_missed"),
    ]


def _brier_sum() -> Column:
    p = F.col("p")
    return F.sum(F.col("pos") * (1.0 - p) * (1.0 - p) + F.col("neg") * p * p)


def confusion(df: DataFrame, threshold: float = 0.5, keys: Sequence[str] = (), cost: Costs = Costs(), from_amounts: bool = True, **cols: str) -> DataFrame:
    """MET1-3, 7, 9, 10 at one threshold; no ordering needed."""
    counts = (
        score_groups(df, keys, **cols)
        .groupBy(*keys)
        .agg(*_confusion_aggregates(threshold), _brier_sum().alias("_b"), F.sum(F.col("pos") + F.col("neg")).alias("n"))
    )
    rates = rate_columns(cost, from_amounts)
    return counts.select(
        *keys, F.lit(float(threshold)).alias("threshold"), "n", "tp", "fp", "tn", "fn",
        *[c.alias(n) for n, c in rates.items()],
        ratio(F.col("_b"), F.col("n")).alias("brier"),
    )


def top_scores(df: DataFrame, k: int, keys: Sequence[str] = (), p: str = "p", row_id: str = "transaction_id") -> DataFrame:
    """The k highest scores (per key) with their rank; ties by id.

    Partitions keep at most k rows before anything moves: a top-k sort without keys,
    a rank limit pushed below the shuffle with keys.
    """
    order = [F.col(p).desc(), F.col(row_id).asc()]
    if not keys:
        window = Window.partitionBy(F.lit(0)).orderBy(*order)
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(window))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def precision_at_k(df: DataFrame, ks: Sequence[int] = (100, 500), y: str = "y", p: str = "p", row_id: str = "transaction_id") -> DataFrame:
    """MET8: rows ``(k, hits, precision_at_k, recall_at_k)``; 0 where k exceeds the table."""
    fraud = (F.col(y) == 1).cast("bigint")
    total = df.agg(F.coalesce(F.sum(fraud), F.lit(0)).alias("total_fraud")).withColumn("_one", F.lit(1))
    top = top_scores(df.select(y, p, row_id), max(ks), p=p, row_id=row_id)
    per_k = (
        top.select(fraud.alias("y"), "rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
        .groupBy("k")
        .agg(
            F.sum(F.when(F.col("rank") <= F.col("k"), F.col("y")).otherwise(0)).alias("hits"),
            F.max("rank").alias("_n"),
        )
        .withColumn("_one", F.lit(1))
    )
    enough = F.col("_n") >= F.col("k")
    return per_k.join(total, "_one").select(
        "k",
        F.when(enough, F.col("hits")).otherwise(0).alias("hits"),
        F.when(enough, F.col("hits") / F.col("k")).otherwise(0.0).alias("precision_at_k"),
        F.when(enough, F.col("hits") / F.greatest(F.col("total_fraud"), F.lit(1))).otherwise(0.0).alias("recall_at_k"),
    )


def fraud_metrics(df: DataFrame, threshold: float = 0.5, cost: Costs = Costs(), from_amounts: bool = True, ks: Sequence[int] = (100, 500), row_id: str = "transaction_id") -> DataFrame:
    """The full one-row report over columns ``y, p, amount`` and an id."""
    roc, step = _auc_terms()
    ordered = _ordered(score_groups(df, amount="amount" if from_amounts else None), [])
    core = ordered.agg(
        F.sum(roc).alias("roc_auc"),
        F.sum(step).alias("pr_auc"),
        ratio(F.sum("pos"), F.sum(F.col("pos") + F.col("neg"))).alias("random_baseline_pr_auc"),
        *_confusion_aggregates(threshold),
        ratio(_brier_sum(), F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
    )
    at_k = precision_at_k(df, ks, row_id=row_id).agg(
        *[F.max(F.when(F.col("k") == k, F.col(f"{m}_at_k"))).alias(f"{m}_at_{k}") for m in ("precision", "recall") for k in ks]
    )
    rates = rate_columns(cost, from_amounts)
    return (
        core.withColumn("_one", F.lit(1))
        .join(at_k.withColumn("_one", F.lit(1)), "_one")
        .select(
            F.lit(float(threshold)).alias("threshold"),
            "roc_auc",
            "pr_auc",
            "random_baseline_pr_auc",
            ratio(F.col("pr_auc"), F.col("random_baseline_pr_auc")).alias("pr_auc_lift"),
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c0) for c0, c in ((n, F.col(n)) for n in ("tp", "fp", "tn", "fn"))],
            *[c.alias(n) for n, c in rates.items()],
            rates["recall"].alias("fraud_recall"),
            "brier",
            *[F.coalesce(F.col(f"{m}_at_{k}"), F.lit(0.0)).alias(f"{m}_at_{k}") for m in ("precision", "recall") for k in ks],
        )
    )


def threshold_curve(df: DataFrame, thresholds: Sequence[float] = CURVE_THRESHOLDS, cost: Costs = Costs(), from_amounts: bool = True, **cols: str) -> DataFrame:
    """MET11: one pass buckets scores between thresholds; the curve is built from the buckets."""
    cuts = sorted(thresholds)
    buckets = (
        score_groups(df, **cols)
        .groupBy(bucket(F.col("p"), cuts).alias("above"))
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("amt_pos").alias("amt_pos"))
    )
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(cuts)])
    hit = F.col("above") > F.col("_t.i")
    curve = (
        buckets.withColumn("_t", F.explode(marks))
        .groupBy(F.col("_t.threshold").alias("threshold"))
        .agg(
            F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
            F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(hit, F.col("amt_pos")).otherwise(0.0)).alias("amt_caught"),
            F.sum(F.when(hit, 0.0).otherwise(F.col("amt_pos"))).alias("amt_missed"),
        )
    )
    return curve.select("threshold", "tp", "fp", "tn", "fn", *[c.alias(n) for n, c in rate_columns(cost, from_amounts).items()])
