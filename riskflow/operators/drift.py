"""Distribution change between a baseline and a target population (DRF1-8).

All features are unpivoted to rows with a count of one in their population. PSI and the
Jensen-Shannon distance add these up in a few bins as they are read. Only the KS statistic,
which looks at every value, needs them counted per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import DriftLevels
from riskflow.functions.prefix import ordered_totals, span_unit
from riskflow.functions.quantiles import refined_quantiles
from riskflow.session import freeze, stored

EPS = 1e-4
EDGE_MARGIN = 1e-5
MIN_VALUES = 10


def both_populations(baseline: DataFrame, target: DataFrame, features: Sequence[str]) -> DataFrame:
    """The features of both tables as doubles, with the marks ``nb`` (1 in the baseline) and ``nt``."""

    def side(df: DataFrame, is_base: int) -> DataFrame:
        return df.select(F.lit(is_base).alias("nb"), F.lit(1 - is_base).alias("nt"), *[F.col(f).cast("double").alias(f) for f in features])

    return side(baseline, 1).unionByName(side(target, 0))


def as_values(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(nb, nt, feature, v)``, a row for every finite value (DRF8)."""
    v = F.col("v")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return both.unpivot(["nb", "nt"], list(features), "feature", "v").where(finite)


def feature_values(baseline: DataFrame, target: DataFrame, features: Sequence[str]) -> DataFrame:
    return as_values(both_populations(baseline, target, features), features)


def stored_values(baseline: DataFrame, target: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature_values`` of features that are computed and written once, since every pass reads them."""
    return as_values(stored(both_populations(baseline, target, features)), features)


def value_counts(baseline: DataFrame, target: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature_values`` with one row for each distinct value; serves wherever those do."""
    values = feature_values(baseline, target, features)
    return values.groupBy("feature", "v").agg(F.sum("nb").alias("nb"), F.sum("nt").alias("nt"))


def feature_span(counts: DataFrame) -> DataFrame:
    """One row per feature: joint bounds and the two population sizes."""
    return counts.groupBy("feature").agg(
        F.min("v").alias("v_lo"),
        F.max("v").alias("v_hi"),
        F.sum("nb").alias("n_base"),
        F.sum("nt").alias("n_target"),
    )


def known_span(values: DataFrame) -> DataFrame:
    """``feature_span`` worked out now: one row for each feature of the caller's list."""
    spans = feature_span(values)
    return values.sparkSession.createDataFrame(spans.collect(), spans.schema)


def with_span(counts: DataFrame) -> DataFrame:
    # One row per feature, so its size is the length of the caller's feature list.
    return counts.join(F.broadcast(feature_span(counts)), "feature")


def ordered_counts(counts: DataFrame) -> DataFrame:
    located = with_span(counts)
    return ordered_totals(located, ["feature"], "v", ["nb", "nt"], unit=span_unit(F.col("v"), F.col("v_lo"), F.col("v_hi")))


def ks_statistic(ordered: DataFrame) -> DataFrame:
    """DRF3: the largest distance between the two cumulative distributions."""
    share_base = (F.col("nb_before") + F.col("nb")) / F.col("nb_total")
    share_target = (F.col("nt_before") + F.col("nt")) / F.col("nt_total")
    both = (F.col("nb_total") > 0) & (F.col("nt_total") > 0)
    return ordered.groupBy("feature").agg(F.max(F.when(both, F.abs(share_base - share_target)).otherwise(0.0)).alias("ks"))


def quantile_edges(values: DataFrame, num_bins: int = 10) -> DataFrame:
    """Exact linear-interpolated quantiles of the baseline, distinct, ends widened."""
    marks = [i / num_bins for i in range(num_bins + 1)]
    quantiles = refined_quantiles(values, "feature", "v", "nb", marks).withColumnRenamed("quantile", "edge")
    widened = F.transform(
        F.col("e"),
        lambda x, i: F.when(i == 0, x - EDGE_MARGIN).when(i == F.size("e") - 1, x + EDGE_MARGIN).otherwise(x),
    )
    return (
        quantiles.groupBy("feature")
        .agg(F.sort_array(F.collect_set("edge")).alias("e"))
        .where(F.size("e") >= 2)
        .select("feature", widened.alias("edges"))
    )


def psi(values: DataFrame, num_bins: int = 10, eps: float = EPS, spans: DataFrame | None = None) -> DataFrame:
    """DRF1. Target values beyond the edges leave the counts but stay in the denominator.

    Reads ``values`` some four times, a handful of counts a feature being shuffled each time.
    """
    edges = quantile_edges(values, num_bins)
    passed: Column = F.lit(0)
    for i in range(num_bins + 1):
        passed = passed + F.coalesce(F.get("edges", F.lit(i)) <= F.col("v"), F.lit(False)).cast("int")
    bins = F.size("edges") - 1
    spans = known_span(values) if spans is None else spans
    per_bin = (
        values.join(F.broadcast(edges), "feature")  # at most one row per feature
        .withColumn("bin", F.when(F.col("v") == F.element_at("edges", -1), bins).otherwise(passed))
        .where(F.col("bin").between(1, bins))
        .groupBy("feature", "bin")
        .agg(F.sum("nb").alias("b"), F.sum("nt").alias("t"))
        .join(F.broadcast(spans), "feature")
    )

    def share(count: str, total: str) -> Column:
        return F.least(F.greatest(F.col(count) / F.col(total), F.lit(eps)), F.lit(1.0))

    b, t = share("b", "n_base"), share("t", "n_target")
    summed = per_bin.where("n_base > 0 AND n_target > 0").groupBy("feature").agg(F.sum((t - b) * F.log(t / b)).alias("psi"))
    return spans.select("feature").join(summed, "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def js_distance(values: DataFrame, num_bins: int = 10, eps: float = EPS, spans: DataFrame | None = None) -> DataFrame:
    """DRF2: square root of the Jensen-Shannon divergence (base e) over equal-width bins."""
    spans = known_span(values) if spans is None else spans
    low = F.col("v_lo") - EDGE_MARGIN
    step = (F.col("v_hi") + EDGE_MARGIN - low) / num_bins
    guess = F.floor((F.col("v") - low) / step)
    # Settle the bin by comparing with the edges themselves, as a histogram does.
    at_least = (F.col("v") >= low + (guess + 1) * step).cast("int")
    too_far = (F.col("v") < low + guess * step).cast("int")
    bin_no = F.least(F.greatest(guess + at_least - too_far, F.lit(0)), F.lit(num_bins - 1))
    scale = 1.0 + num_bins * eps
    p = (F.col("b") / F.col("n_base") + eps) / scale
    q = (F.col("t") / F.col("n_target") + eps) / scale
    m = (p + q) / 2.0
    usable = (F.col("n_base") > 0) & (F.col("n_target") > 0) & (F.col("v_lo") < F.col("v_hi"))
    summed = (
        values.join(F.broadcast(spans), "feature")
        .where(usable)
        .groupBy("feature", bin_no.alias("bin"))
        .agg(F.sum("nb").alias("b"), F.sum("nt").alias("t"), F.max("n_base").alias("n_base"), F.max("n_target").alias("n_target"))
        .groupBy("feature")
        .agg(F.sum(p * F.log(p / m) + q * F.log(q / m)).alias("s"))
    )
    return spans.select("feature").join(summed, "feature", "left").select(
        "feature", F.coalesce(F.sqrt(F.greatest(F.col("s") / 2.0, F.lit(0.0))), F.lit(0.0)).alias("js")
    )


def severity(value: Column, levels: tuple[float, float]) -> Column:
    return F.when(value >= levels[1], "critical").when(value >= levels[0], "warning").otherwise("none")


def check_drift(
    baseline: DataFrame,
    target: DataFrame,
    features: Sequence[str],
    metrics: Sequence[str] = ("psi", "ks"),
    levels: DriftLevels = DriftLevels(),
    psi_bins: int = 10,
    js_bins: int = 50,
) -> DataFrame:
    """DRF3-5: rows ``(feature, metric, value, severity, warning, critical)``.

    Features with fewer than 10 values on a side are not judged: their severity is 'skipped', their value null.
    """
    unknown = set(metrics) - {"psi", "ks", "js"}
    if unknown:
        raise ValueError(f"unknown drift metric: {sorted(unknown)}")
    # Only KS needs every distinct value; its counts are then read by every metric.
    values = freeze(value_counts(baseline, target, features)) if "ks" in metrics else stored_values(baseline, target, features)
    spans = known_span(values)
    computed = {
        "psi": lambda: psi(values, psi_bins, spans=spans),
        "ks": lambda: ks_statistic(ordered_counts(values)),
        "js": lambda: js_distance(values, js_bins, spans=spans),
    }
    enough = spans.select("feature", ((F.col("n_base") >= MIN_VALUES) & (F.col("n_target") >= MIN_VALUES)).alias("enough"))
    out = None
    for metric in metrics:
        rows = computed[metric]().select("feature", F.lit(metric).alias("metric"), F.col(metric).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    # one row per feature and metric of the caller's lists
    asked = values.sparkSession.createDataFrame(
        [(f, m, *map(float, getattr(levels, m))) for f in features for m in metrics], "feature string, metric string, warning double, critical double"
    )
    judged = F.coalesce("enough", F.lit(False))
    return asked.join(F.broadcast(enough), "feature", "left").join(out, ["feature", "metric"], "left").select(
        "feature",
        "metric",
        F.when(judged, F.col("value")).alias("value"),
        F.when(judged, severity(F.col("value"), (F.col("warning"), F.col("critical")))).otherwise("skipped").alias("severity"),
        "warning",
        "critical",
    )


def drift_summary(results: DataFrame) -> DataFrame:
    """DRF5, DRF7: one row with the overall severity and the affected features."""
    critical, warning = F.col("severity") == "critical", F.col("severity") == "warning"
    rank = F.max(F.when(critical, 2).when(warning, 1).otherwise(0))
    return results.agg(
        F.count_if(F.col("severity") != "skipped").alias("checks"),
        F.count_if(critical).alias("n_critical"),
        F.count_if(warning).alias("n_warning"),
        F.coalesce(rank, F.lit(0)).alias("_rank"),
        F.sort_array(F.collect_set(F.when(critical, F.col("feature")))).alias("critical_features"),
        F.sort_array(F.collect_set(F.when(warning, F.col("feature")))).alias("warning_features"),
    ).select(
        "checks",
        "n_critical",
        "n_warning",
        F.when(F.col("_rank") == 2, "critical").when(F.col("_rank") == 1, "warning").otherwise("none").alias("overall_severity"),
        (F.col("_rank") > 0).alias("drift_detected"),
        "critical_features",
        "warning_features",
    )


def population_drift(baseline: DataFrame, target: DataFrame, features: Sequence[str], num_bins: int = 10) -> DataFrame:
    """DRF6: PSI, JS distance and a status per feature."""
    values = stored_values(baseline, target, features)
    spans = known_span(values)
    both = psi(values, num_bins, spans=spans).join(js_distance(values, num_bins, spans=spans), "feature")
    p = F.col("psi")
    status = F.when(p >= 0.2, "SIGNIFICANT_DRIFT").when(p >= 0.1, "SLIGHT_DRIFT").otherwise("NO_DRIFT")
    return both.select("feature", "psi", F.col("js").alias("js_distance"), status.alias("status"))


def overall_drift(report: DataFrame) -> DataFrame:
    """The mean PSI over features; 0 without features."""
    return report.agg(F.coalesce(F.avg("psi"), F.lit(0.0)).alias("overall_psi"), F.count(F.lit(1)).alias("features"))
