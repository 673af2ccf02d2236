"""MET12: bootstrap intervals of the headline metrics.

Each row gets an independent Poisson(1) weight per replicate, the streaming form of
resampling with replacement. Only rows of the positive class are weighted one by one.
Rank metrics depend on the others only through how many lie between two neighbouring
positive scores, so those are weighted per such gap: a sum of n Poisson(1) weights is
Poisson(n). Work is (positives + gaps) × replicates, not rows × replicates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import Costs
from riskflow.functions.buckets import bucket
from riskflow.functions.prefix import ordered_totals, running_totals, unit_cells
from riskflow.operators.metrics import fraud_metrics, ratio, score_groups

#: Up to this mean a draw is the sum of draws of mean 1; beyond, one by rejection.
SUMMED_UP_TO = 30
#: Proposals of a draw; each is refused less than once in six, so that all are is less likely than 1e-49.
PROPOSALS = 64


def _poisson1_cdf(terms: int = 16) -> list[float]:
    out, total = [], 0.0
    for k in range(terms):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(total)
    return out


_CDF = _poisson1_cdf()


def uniform(*parts: Column) -> Column:
    """A repeatable number in [0, 1) from a 64-bit hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def poisson1(*parts: Column) -> Column:
    return bucket(uniform(*parts), _CDF)


def _log_relative(k: Column, n: Column) -> Column:
    """Logarithm of the Poisson(n) probability of ``k``; from its distance to n, so that nothing cancels where both are large."""
    least = F.greatest(k, F.lit(10.0))
    stirling = 1 / (12 * least) - 1 / (360 * least**3) + 1 / (1260 * least**5) - 1 / (1680 * least**7)
    far = k - n - k * F.log1p((k - n) / n) - 0.5 * F.log(2 * math.pi * least) - stirling
    factorials = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)])
    return F.when(k >= 10, far).otherwise(k * F.log(n) - n - F.element_at(factorials, (k + 1).cast("int")))


def _rejected(n: Column, *parts: Column) -> Column:
    """Poisson(n) for n beyond 10 by transformed rejection: proposals under a hat of fixed shape, the first that the exact probability accepts."""
    b = 0.931 + 2.53 * F.sqrt(n)
    a = -0.059 + 0.02483 * b
    inverse_alpha, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6624 / (b - 2)

    def proposal(i: Column) -> Column:
        u, v = uniform(*parts, i, F.lit("u")) - 0.5, 1.0 - uniform(*parts, i, F.lit("v"))
        us = 0.5 - F.abs(u) + F.lit(2.0**-54)
        k = F.floor((2 * a / us + b) * u + n + 0.43).cast("double")
        inner = (us >= 0.07) & (v <= squeeze)
        outer = (k < 0) | ((us < 0.013) & (v > us))
        under = F.log(v * inverse_alpha / (a / (us * us) + b)) <= _log_relative(k, n)
        return F.when(inner | (~outer & under), k)

    return F.aggregate(F.sequence(F.lit(1), F.lit(PROPOSALS)), F.lit(None).cast("double"), lambda found, i: F.when(found.isNotNull(), found).otherwise(proposal(i)))


def poisson(n: Column, *parts: Column) -> Column:
    """Poisson(n) from hashes of ``parts``: n draws of mean 1 added up while n is small, one draw by rejection beyond; both have the exact distribution."""
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(SUMMED_UP_TO))).cast("int")),
        F.lit(0),
        lambda acc, i: acc + poisson1(*parts, i),
    )
    wide = _rejected(n.cast("double"), *parts)
    return F.when(n <= 0, F.lit(0)).when(n <= SUMMED_UP_TO, drawn).otherwise(wide).cast("bigint")


def replicates(df: DataFrame, threshold: float, n_boot: int, seed: int, row_id: str) -> DataFrame:
    """``(b, slot, above, pos, neg, amt)``: weighted counts in score-descending slots."""
    groups = score_groups(df).withColumn("has", (F.col("pos") > 0).cast("bigint"))
    ranked = ordered_totals(groups, [], "p", ["has"], descending=True).select(
        "p",
        "neg",
        "has",
        (F.col("p") >= threshold).cast("int").alias("above"),
        # Odd slots hold one positive score, even slots the gap before it. A gap cut by
        # the threshold gives two slots, the one above the threshold first.
        (4 * F.col("has_before") + 2 * F.col("has") + (F.col("p") < threshold).cast("int")).alias("slot"),
        (4 * F.col("has_total") + 4).alias("n_slots"),
    )
    boots = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")
    positives = (
        df.where(F.col("y") == 1)
        .select(F.col("p").cast("double").alias("p"), "amount", F.col(row_id).alias("_id"), boots)
        .withColumn("w", poisson1(F.col("_id"), F.col("b"), F.lit(seed)))
        .where("w > 0")
        .groupBy("b", "p")
        .agg(F.sum("w").cast("bigint").alias("pos"), F.sum(F.col("w") * F.col("amount")).alias("amt"))
        .join(ranked.where("has = 1").select("p", "slot", "above", "n_slots"), "p")
        .select("b", "slot", "above", "n_slots", "pos", F.lit(0).cast("bigint").alias("neg"), "amt")
    )
    negatives = (
        ranked.groupBy("slot", "above", "n_slots")
        .agg(F.sum("neg").alias("n"))
        .where("n > 0")
        .select("slot", "above", "n_slots", "n", boots)
        .select(
            "b", "slot", "above", "n_slots", F.lit(0).cast("bigint").alias("pos"),
            poisson(F.col("n"), F.col("slot"), F.col("b"), F.lit(seed)).alias("neg"), F.lit(0.0).alias("amt"),
        )
    )
    return (
        positives.unionByName(negatives)
        .groupBy("b", "slot", "above", "n_slots")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("amt").alias("amt"))
    )


def bootstrap_metrics(df: DataFrame, threshold: float = 0.5, n_boot: int = 1000, seed: int = 42, cost: Costs = Costs(), row_id: str = "transaction_id") -> DataFrame:
    """One row of metrics per replicate; replicates with a single class are left out."""
    weighted = replicates(df, threshold, n_boot, seed, row_id)
    first, second = unit_cells(F.col("slot") / F.col("n_slots"))
    ordered = running_totals(
        weighted.withColumn("_cell1", first).withColumn("_cell2", second), ["b"], ["_cell1", "_cell2"], ["slot"], ["pos", "neg"]
    )
    pos, neg = F.col("pos"), F.col("neg")
    tp, fp, all_pos, all_neg = F.col("pos_before"), F.col("neg_before"), F.col("pos_total"), F.col("neg_total")
    here = pos + neg

    def hits(k: int) -> Column:
        taken = F.greatest(F.least(F.lit(k) - tp - fp, here), F.lit(0))
        return F.sum(F.when(here > 0, taken * pos / here).otherwise(0.0)) / k

    above = F.col("above") == 1
    per_b = ordered.where((all_pos > 0) & (all_neg > 0)).groupBy("b").agg(
        F.sum(pos * (all_neg - fp - neg / 2.0) / (all_pos.cast("double") * all_neg)).alias("roc_auc"),
        F.sum(F.when(pos > 0, (pos / all_pos) * ((tp + pos) / (tp + pos + fp + neg))).otherwise(0.0)).alias("pr_auc"),
        F.sum(F.when(above, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(above, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(above, 0).otherwise(pos)).alias("fn"),
        F.sum(F.when(above, F.col("amt")).otherwise(-F.col("amt"))).alias("money"),
        F.max(all_pos + all_neg).alias("n"),
        hits(100).alias("h100"),
        hits(500).alias("h500"),
    )
    t, f, m = F.col("tp"), F.col("fp"), F.col("fn")
    return per_b.select(
        "b",
        "pr_auc",
        "roc_auc",
        ratio(t, t + f).alias("precision"),
        ratio(t, t + m).alias("recall"),
        ratio(2.0 * t, 2.0 * t + f + m).alias("f1"),
        F.when(F.col("n") >= 100, F.col("h100")).otherwise(0.0).alias("p_at_100"),
        F.when(F.col("n") >= 500, F.col("h500")).otherwise(0.0).alias("p_at_500"),
        (F.col("money") - f * cost.false_positive).alias("net_benefit"),
    )


_METRICS = ["pr_auc", "roc_auc", "precision", "recall", "f1", "p_at_100", "p_at_500", "net_benefit"]


def bootstrap_ci(df: DataFrame, threshold: float = 0.5, n_boot: int = 1000, seed: int = 42, cost: Costs = Costs(), row_id: str = "transaction_id") -> DataFrame:
    """Rows ``(metric, estimate, lo, hi)`` with the 2.5 and 97.5 percentiles over replicates."""
    samples = bootstrap_metrics(df, threshold, n_boot, seed, cost, row_id)
    bounds = (
        samples.unpivot(["b"], _METRICS, "metric", "value")
        .groupBy("metric")
        .agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    )
    point = (
        fraud_metrics(df, threshold, cost, row_id=row_id)
        .withColumnsRenamed({"precision_at_100": "p_at_100", "precision_at_500": "p_at_500"})
        .unpivot([], _METRICS, "metric", "estimate")
    )
    return point.join(bounds, "metric", "left").select(
        "metric",
        "estimate",
        F.coalesce(F.get("q", F.lit(0)), F.col("estimate")).alias("lo"),
        F.coalesce(F.get("q", F.lit(1)), F.col("estimate")).alias("hi"),
    )
