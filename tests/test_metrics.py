import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.operators import bootstrap as B
from riskflow.operators import metrics as M
from riskflow.operators import thresholds as TH
from riskflow.operators.decisions import decide, out_of_bounds


def frame(spark, y, p, amount=None):
    amount = amount or [10.0] * len(y)
    rows = [(f"T{i:05d}", int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, amount))]
    return spark.createDataFrame(rows, "transaction_id string, y int, p double, amount double")


def random_case(seed, n=400, levels=37):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.15).astype(int)
    p = np.clip(np.round((rng.random(n) * 0.7 + y * 0.3) * levels) / levels, 0, 1)
    return y.tolist(), p.tolist(), rng.uniform(1, 100, n).round(2).tolist()


def auc_by_pairs(y, p):
    pos = [b for a, b in zip(y, p) if a == 1]
    neg = [b for a, b in zip(y, p) if a == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def average_precision(y, p):
    total, out, seen = sum(y), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = [a for a, b in zip(y, p) if b >= t]
        recall = sum(hit) / total
        out += (recall - seen) * sum(hit) / len(hit)
        seen = recall
    return out


def test_known_ranking(spark):
    row = M.ranking(frame(spark, [1, 0, 1, 0, 1, 0], [0.9, 0.8, 0.7, 0.7, 0.3, 0.1])).first()
    assert math.isclose(row["pr_auc"], 0.7) and math.isclose(row["roc_auc"], 0.611111, abs_tol=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_against_definitions(spark, seed):
    y, p, amount = random_case(seed)
    row = M.ranking(frame(spark, y, p, amount)).first()
    assert math.isclose(row["roc_auc"], auc_by_pairs(y, p), abs_tol=1e-12)
    assert math.isclose(row["pr_auc"], average_precision(y, p), abs_tol=1e-12)


def test_scores_packed_into_one_cell_keep_their_order(spark):
    y = [1, 0, 1, 0, 0, 1, 0, 1]
    p = [0.5 + i * 1e-13 for i in range(len(y))]
    assert math.isclose(M.ranking(frame(spark, y, p)).first()["roc_auc"], auc_by_pairs(y, p))


def test_one_class_gives_zero(spark):
    row = M.fraud_metrics(frame(spark, [0, 0, 0], [0.1, 0.2, 0.9])).first()
    assert (row["roc_auc"], row["pr_auc"], row["precision"], row["recall"], row["f1"]) == (0, 0, 0, 0, 0)
    assert row["precision_at_100"] == 0.0  # more than the table holds


def test_published_counts(spark):
    counts = spark.createDataFrame([(300, 36, 160441, 359, 0.0, 0.0)], "tp long, fp long, tn long, fn long, amt_caught double, amt_missed double")
    row = counts.select(*[c.alias(n) for n, c in M.rate_columns(from_amounts=False).items()]).first()
    assert [round(row[k], 4) for k in ("precision", "recall", "f1", "false_positive_rate")] == [0.8929, 0.4552, 0.603, 0.0002]
    assert row["false_positive_cost"] == 900.0


def test_engine_cost_of_published_counts(spark):
    y = [1] * 3 + [0] * 9 + [0] * 96
    p = [0.9] * 3 + [0.9] * 9 + [0.5] * 96
    row = TH.cost_at(frame(spark, y, p), 0.35, 0.8).first()
    assert row["false_declines"] == 9 and row["manual_reviews"] == 96
    assert row["false_positive_cost"] + row["review_cost"] == 705.0


def test_top_k_ties_by_id(spark):
    df = frame(spark, [0, 1, 1, 0], [0.5, 0.5, 0.5, 0.5])
    row = M.precision_at_k(df, [2]).first()
    assert row["precision_at_k"] == 0.5 and row["recall_at_k"] == 0.5


def test_keyed_top_k_limits_before_the_shuffle(spark):
    df = frame(spark, *random_case(4)[:2]).withColumn("g", F.col("y"))
    plan = M.top_scores(df, 3, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_grid_against_full_scans(spark):
    y, p, amount = random_case(7)
    best = TH.best_thresholds(frame(spark, y, p, amount), 12).first()
    ya, pa, am = map(np.asarray, (y, p, amount))
    top = (-math.inf, None, None)
    for a in TH.linspace(0.01, 0.5, 12):
        for b in TH.linspace(0.1, 0.95, 12):
            if b <= a:
                continue
            net = am[(pa >= a) & (ya == 1)].sum() - am[(pa < a) & (ya == 1)].sum() - 25 * ((pa >= b) & (ya == 0)).sum() - 5 * ((pa >= a) & (pa < b)).sum()
            if net > top[0] + 1e-9:
                top = (net, a, b)
    assert math.isclose(best["net_benefit"], top[0], abs_tol=1e-6)
    assert (best["approve_threshold"], best["block_threshold"]) == (top[1], top[2])


def test_curve_equals_single_thresholds(spark):
    df = frame(spark, *random_case(9))
    curve = {r["threshold"]: r for r in M.threshold_curve(df).collect()}
    assert len(curve) == 11
    for t in (0.05, 0.5, 0.9):
        one = M.confusion(df, t).first()
        assert all(curve[t][k] == one[k] for k in ("tp", "fp", "tn", "fn")) and math.isclose(curve[t]["net_benefit"], one["net_benefit"])


def test_poisson_weights_average_one(spark):
    weights = spark.range(20000).select(B.poisson1(F.col("id"), F.lit(3)).alias("w"), B.poisson(F.lit(400), F.col("id")).alias("n"), B.poisson(F.lit(7), F.col("id")).alias("k"))
    row = weights.agg(F.avg("w"), F.var_samp("w"), F.avg("n"), F.var_samp("n"), F.avg("k"), F.var_samp("k")).first()
    for got, want, tol in zip(row, (1, 1, 400, 400, 7, 7), (0.03, 0.05, 0.6, 16, 0.08, 0.35)):
        assert abs(got - want) < tol


@pytest.mark.parametrize("n", [31, 47, 300, 20_000])
def test_large_poisson_draws_have_the_exact_distribution(spark, n):
    size = 60_000
    drawn = [r.k for r in spark.range(size).select(B.poisson(F.lit(n), F.col("id"), F.lit(5)).alias("k")).collect()]
    log_p = lambda k: k * math.log(n) - n - math.lgamma(k + 1)
    width, low = max(1, int(math.sqrt(n) / 3)), max(0, int(n - 6 * math.sqrt(n)))
    expected, seen = {}, {}
    for k in range(low, int(n + 6 * math.sqrt(n))):
        expected[(k - low) // width] = expected.get((k - low) // width, 0.0) + size * math.exp(log_p(k))
    for k in drawn:
        seen[(k - low) // width] = seen.get((k - low) // width, 0) + 1
    cells = [c for c in expected if expected[c] >= 8]
    squares = sum((seen.get(c, 0) - expected[c]) ** 2 / expected[c] for c in cells)
    assert squares < len(cells) + 4 * math.sqrt(2 * len(cells)), (squares, len(cells))


def test_poisson_draws_of_very_large_means(spark):
    row = spark.range(20_000).select(((B.poisson(F.lit(10**12), F.col("id")) - 10**12) / 10**6).alias("z")).agg(F.avg("z"), F.stddev("z"), F.skewness("z"), F.count("z")).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and abs(row[2]) < 0.08 and row[3] == 20_000


def test_log_probabilities_equal_the_definition(spark):
    rows = spark.createDataFrame([(float(k), float(n)) for n in (31, 1000) for k in (0, 1, 9, 10, 11, 40, 1000, 1100)], "k double, n double")
    for r in rows.select("k", "n", B._log_relative(F.col("k"), F.col("n")).alias("got")).collect():
        assert math.isclose(r.got, r.k * math.log(r.n) - r.n - math.lgamma(r.k + 1), rel_tol=1e-11, abs_tol=1e-10)


def test_bootstrap_surrounds_the_estimate_and_matches_resampling(spark):
    y, p, amount = random_case(11, n=600)
    rows = {r["metric"]: r for r in B.bootstrap_ci(frame(spark, y, p, amount), 0.5, n_boot=200).collect()}
    assert len(rows) == 8
    for m in ("pr_auc", "roc_auc", "precision", "recall", "net_benefit"):
        assert rows[m]["lo"] <= rows[m]["estimate"] <= rows[m]["hi"]
    rng, ya, pa = np.random.default_rng(0), np.asarray(y), np.asarray(p)
    drawn = [rng.integers(0, 600, 600) for _ in range(200)]
    aucs = [auc_by_pairs(ya[i].tolist(), pa[i].tolist()) for i in drawn[:60]]
    width = np.percentile(aucs, 97.5) - np.percentile(aucs, 2.5)
    assert 0.5 < (rows["roc_auc"]["hi"] - rows["roc_auc"]["lo"]) / width < 2.0


def test_scores_levels_decisions(spark):
    df = spark.createDataFrame([(0.01,), (0.05,), (0.10,), (0.50,), (1.0,), (1.7,), (None,)], "p double")
    rows = decide(df).collect()
    assert [r["risk_score"] for r in rows] == [100, 223, 316, 707, 1000, 1000, 0]
    assert [r["decision"] for r in rows] == ["APPROVE", "APPROVE", "REVIEW", "BLOCK", "BLOCK", "BLOCK", "REVIEW"]
    assert rows[-1]["risk_level"] == "UNKNOWN"
    assert out_of_bounds(decide(df)).count() == 1  # the probability above one is reported
