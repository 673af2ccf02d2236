"""Quality, leakage, splits, encoding, drift, gates, state tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.config import HALF_YEAR_2026, DatasetExpectation
from riskflow.functions import quantiles
from riskflow.operators import drift as D
from riskflow.operators import encode as E
from riskflow.operators import entity_state as ES
from riskflow.operators import gates as G
from riskflow.operators import leakage as L
from riskflow.operators import monitoring as MO
from riskflow.operators import quality as Q
from riskflow.operators import registry as R
from riskflow.operators import splits as S
from riskflow.operators.velocity import entity_rows
from riskflow.plans.features import BASIC, ENGINEERED, feature_table
from riskflow.schema import CATEGORICAL, COLUMNS, FORBIDDEN
from riskflow.sources.files import DatasetNotFoundError, read_csv, read_parquet, write_table


def status(df, **kw):
    return {r["check"]: r["status"] for r in Q.validate(df, fail_fast=False, **kw).collect()}


def test_clean_table_passes(txns):
    assert set(status(txns([{}, {}])).values()) == {"passed"}


def test_each_defect_is_named(txns):
    df = txns([{"transaction_id": "X"}, {"transaction_id": "X", "proxy_type": None}, {"event_timestamp": dt.datetime(2025, 12, 1)}])
    found = status(df, expected=DatasetExpectation(row_count=10, fraud_count=5))
    assert [found[c] for c in ("txn_id_unique", "no_nulls", "timestamp_range", "row_count", "target_distribution")] == ["failed"] * 4 + ["warning"]
    with pytest.raises(Q.QualityError, match="row_count"):
        Q.validate(df, DatasetExpectation(row_count=10))


def test_schema_and_type_defects(txns):
    df = txns([{}])
    assert Q.column_problems([c for c in COLUMNS if c != "amount"]).startswith("missing")
    assert Q.column_problems(list(reversed(COLUMNS))) == "column order differs"
    assert status(df.withColumn("amount", F.lit("ten")))["data_types"] == "failed"
    assert status(df.unionByName(df), check_duplicate_rows=True)["no_duplicate_rows"] == "failed"


def test_outlier_with_fraud_warns(txns):
    assert status(txns([{"is_outlier": 1, "true_fraud_label": 1}]))["outlier_fraud_separation"] == "warning"


def test_fingerprint_ignores_order_and_sees_changes(txns):
    df = txns([{"amount": float(i)} for i in range(20)])
    one = Q.fingerprint(df, ["transaction_id", "amount"]).first()
    assert one == Q.fingerprint(df.orderBy(F.desc("transaction_id")), ["transaction_id", "amount"]).first()
    changed = df.withColumn("amount", F.when(F.col("transaction_id") == "T00003", 99.5).otherwise(F.col("amount")))
    assert one != Q.fingerprint(changed, ["transaction_id", "amount"]).first()


def test_leakage_guards(txns):
    df = txns([{}])
    with pytest.raises(L.LeakageError) as e:
        L.assert_no_leakage(df)
    assert set(e.value.columns) == set(FORBIDDEN)
    L.assert_no_leakage(L.strip_labels(df))
    safe = L.safe_columns(COLUMNS)
    assert not {"is_outlier", "transaction_id", *FORBIDDEN} & set(safe) and "amount" in safe


def test_split_edges_and_gap(txns):
    times = ["2026-04-30 23:59:59", "2026-04-30 23:59:59.5", "2026-05-01 00:00:00", "2026-05-15 23:59:59", "2026-05-16 00:00:00", "2026-05-31 23:59:59", "2026-06-01 00:00:00"]
    df = S.assign_split(txns([{"event_timestamp": dt.datetime.fromisoformat(t)} for t in times]), HALF_YEAR_2026)
    got = [r["subsplit"] for r in df.orderBy("transaction_id").collect()]
    assert got == ["TRAIN", "GAP", "VAL_CALIB", "VAL_CALIB", "VAL_OPT", "VAL_OPT", "TEST"]
    assert tuple(S.split_overlaps(df, HALF_YEAR_2026).first()) == (0, 1)


def test_alignment(spark):
    df = spark.createDataFrame([(1.0, float("nan"), float("inf"), None)], "a double, b double, c double, d double")
    assert tuple(S.align_to(df, ["d", "c", "missing", "b", "a"]).first()) == (0.0, 0.0, 0.0, 0.0, 1.0)
    assert S.common_columns(df, df.select("c", "a")) == ["a", "c"]


def test_train_frequencies_apply_to_validation(txns):
    train = txns([{"card_type": "CREDIT" if i < 90 else "DEBIT"} for i in range(100)])
    val = txns([{"card_type": "CREDIT"}, {"card_type": "TOTALLY_NEW"}, {"card_type": None}])
    for limit in (200, 1):  # maps, then the join
        enc = E.FrequencyEncoder.fit(train, ["card_type"], map_limit=limit)
        got = {r["card_type"]: r["card_type_encoded"] for r in enc.transform(val).collect()}
        assert got == {"CREDIT": 0.9, "TOTALLY_NEW": 0.0, None: 0.0}


def test_own_frequencies_warn_and_nulls_leave_the_denominator(txns):
    with pytest.warns(UserWarning):
        got = E.encode_with_own_frequencies(txns([{"currency": "USD"}, {"currency": "EUR"}, {"currency": None}]), ["currency"])
    assert sorted(r["currency_encoded"] for r in got.collect()) == [0.0, 0.5, 0.5]


def test_feature_table_shape(txns):
    df = txns([{"proxy_type": None, "amount": None}, {}, {"credit_limit": 0.0}])
    enc = E.FrequencyEncoder.fit(df)
    basic, full, exact = feature_table(df, enc, False), feature_table(df, enc), feature_table(df, enc, exact=True)
    assert (len(basic.columns) - 1, len(full.columns) - 1, len(exact.columns) - 1) == (49, 79, 151)
    assert set(BASIC) < set(ENGINEERED) and not set(FORBIDDEN) & set(exact.columns)
    nulls = full.select([F.count_if(F.col(c).isNull()).alias(c) for c in full.columns]).first()
    assert sum(nulls) == 0 and full.count() == 3


def test_registry(spark):
    rows = {r["name"]: r for r in R.catalogue(spark).collect()}
    assert len(rows) == 151 and sum(r.in_default_set for r in rows.values()) == 79
    assert sum(r.family == "velocity" for r in rows.values()) == 72 and sum(r.family == "categorical" for r in rows.values()) == len(CATEGORICAL)
    # what the rules make of an unknown transaction
    assert rows["time_since_prev_ip_txn_seconds"].default_value == -1.0 and rows["geo_mismatch_count"].default_value == 6.0
    assert rows["card_amount_sum_6h"].window == "6h" and rows["is_tor"].type == "int" and not rows["is_tor"].needs_history


# ── drift ──


def psi_np(b, t, n=10, eps=1e-4):
    edges = np.unique(np.percentile(b, np.linspace(0, 100, n + 1)))
    if len(edges) < 2:
        return 0.0
    edges[0] -= 1e-5
    edges[-1] += 1e-5
    x = np.clip(np.histogram(b, edges)[0] / len(b), eps, 1)
    y = np.clip(np.histogram(t, edges)[0] / len(t), eps, 1)
    return float(((y - x) * np.log(y / x)).sum())


def test_drift_against_arrays(spark):
    rng = np.random.default_rng(3)
    base = {"a": rng.normal(0, 1, 500), "b": rng.integers(0, 5, 500).astype(float), "c": np.full(500, 2.0)}
    target = {"a": rng.normal(0.4, 2, 300), "b": rng.integers(1, 7, 300).astype(float), "c": np.full(300, 2.0)}
    frames = [spark.createDataFrame(list(zip(*[map(float, v) for v in d.values()])), "a double, b double, c double") for d in (base, target)]
    rows = {(r["feature"], r["metric"]): r for r in D.check_drift(*frames, ["a", "b", "c"], ("psi", "ks", "js")).collect()}
    for f in base:
        assert math.isclose(rows[f, "psi"]["value"], psi_np(base[f], target[f]), abs_tol=1e-9)
        grid = np.unique(np.concatenate([base[f], target[f]]))
        ks = max(abs((base[f] <= g).mean() - (target[f] <= g).mean()) for g in grid)
        assert math.isclose(rows[f, "ks"]["value"], ks, abs_tol=1e-12)
    assert rows["c", "js"]["value"] == 0.0 and rows["c", "psi"]["value"] == 0.0
    assert rows["a", "psi"]["severity"] == "critical"
    summary = D.drift_summary(D.check_drift(*frames, ["a", "b", "c"])).first()
    assert summary["overall_severity"] == "critical" and "a" in summary["critical_features"] and summary["drift_detected"]


def test_refined_quantiles_against_arrays(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = {
        "normal": rng.normal(0, 1, 700),
        "ties": np.repeat([1.0, 2.0, 5.0], 100),
        "one": np.array([7.5]),
        "outlier": np.append(rng.uniform(1, 2, 400), [1e300, -1e300, 1.7e308]),
        "tiny": np.append(rng.uniform(1, 2, 300) * 1e-310, [1e5, 0.0, -5e-324, 5e-324]),
        "magnitudes": np.exp(rng.normal(0, 60, 500)) * rng.choice([-1, 1], 500),
        "neighbours": np.array([1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 1e16]),
    }
    qs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.77, 0.9, 0.999, 1.0]
    df = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a], "feature string, v double")
    passes, narrowed = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda *a: passes.append(1) or narrowed(*a))
    got = {(r.feature, r.q): r.quantile for r in quantiles.refined_quantiles(df.withColumn("n", F.lit(1)), "feature", "v", "n", qs).collect()}
    assert len(got) == len(data) * len(qs) and len(passes) <= 10
    for k, a in data.items():
        x = np.sort(a)
        for q in qs:
            rank = (len(x) - 1) * q
            low, high = x[math.floor(rank)], x[math.ceil(rank)]
            assert got[k, q] == low + (high - low) * (rank - math.floor(rank)), (k, q)
    # counts weigh like repeated rows, few cells only take more passes, and rows without weight do not exist
    weighted = df.groupBy("feature", "v").agg((F.count(F.lit(1)) * 3).alias("n")).union(spark.createDataFrame([("ties", 99.0, 0)], "f string, v double, n long"))
    tripled = {(r.feature, r.q): r.quantile for r in quantiles.refined_quantiles(weighted, "feature", "v", "n", [0.25, 0.5], cells=4).collect()}
    for k, a in data.items():
        x = np.sort(np.repeat(a, 3))
        for q in (0.25, 0.5):
            rank = (len(x) - 1) * q
            low, high = x[math.floor(rank)], x[math.ceil(rank)]
            assert tripled[k, q] == low + (high - low) * (rank - math.floor(rank)), (k, q)
    assert quantiles.refined_quantiles(df.where("false").withColumn("n", F.lit(1)), "feature", "v", "n", qs).count() == 0


def test_population_drift_counts_no_distinct_values(spark):
    """What a pass shuffles does not grow with the rows."""
    def frames(n):
        return [spark.range(n).select((F.rand(seed) * 1000).alias("a"), F.randn(seed).alias("b")) for seed in (1, 2)]

    report = {r.feature: r for r in D.population_drift(*frames(20000), ["a", "b"]).collect()}
    base, target = [{c: np.array([r[c] for r in f.collect()]) for c in ("a", "b")} for f in frames(20000)]
    for f in ("a", "b"):
        assert math.isclose(report[f].psi, psi_np(base[f], target[f]), abs_tol=1e-9)
    plan = D.psi(D.feature_values(*frames(20000), ["a", "b"]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [feature#" in plan and not any(", v#" in line.split("]")[0] for line in plan.splitlines() if "Aggregate [" in line)


def test_drift_skips_small_sides_and_non_finite(spark):
    few = spark.createDataFrame([(float(i),) for i in range(9)], "x double")
    bad = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), *[(float(i),) for i in range(12)]], "x double")
    assert {r.severity for r in D.check_drift(few, bad, ["x"]).collect()} == {'skipped'}  # reported, not judged
    counts = D.value_counts(bad, bad, ["x"])
    assert counts.agg(F.sum("nb")).first()[0] == 12
    with pytest.raises(ValueError):
        D.check_drift(bad, bad, ["x"], ("other",))


# ── gates, monitoring, state ──


def metrics_row(spark, **kw):
    base = {"pr_auc": 0.4527, "recall": 0.4552, "false_positive_rate": 0.0002, "brier": 0.002397, "total_expected_cost": 50000.0}
    base.update(kw)
    return spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} double" for k in base))


def test_published_model_is_rejected_on_recall(spark):
    row = G.promotion_decision(G.promotion_gates(metrics_row(spark))).first()
    assert not row["approved"] and row["reason"] == "REJECTED: recall" and row["n_passed"] == 7


def test_gates_for_flags(spark):
    good = metrics_row(spark, recall=0.8)
    assert G.promotion_decision(G.promotion_gates(good)).first()["approved"]
    row = G.promotion_decision(G.promotion_gates(good, has_calibration=False, has_drift=True, has_leakage=True)).first()
    assert row["reason"] == "REJECTED: calibration; drift; leakage"


@pytest.mark.parametrize("ap, recall, drift, retrain", [(0.39, 0.8, False, True), (0.45, 0.69, False, True), (0.42, 0.8, False, False), (0.42, 0.8, True, True), (0.45, 0.8, True, False)])
def test_retrain_trigger(spark, ap, recall, drift, retrain):
    got = G.retrain_trigger(metrics_row(spark, pr_auc=ap, recall=recall), metrics_row(spark, recall=0.8), drift).first()
    assert got["retrain"] is retrain


def test_histogram_counts_values_on_the_bound(spark):
    df = spark.createDataFrame([(0.1,), (0.1000001,), (5.0,)], "v double")
    got = {r["upper_bound"]: r["n"] for r in MO.cumulative_histogram(df, "v", [0.1, 1.0]).collect()}
    assert got == {0.1: 1, 1.0: 2, float("inf"): 3}


def test_latency_percentiles_interpolate(spark):
    v = [float(x) for x in (5, 1, 9, 3, 3, 20, 7)]
    row = MO.latency_percentiles(spark.createDataFrame([(x,) for x in v], "latency_ms double"), ts=None).first()
    assert [round(x, 9) for x in row] == [round(float(np.percentile(v, q)), 9) for q in (50, 95, 99)]


def test_gap_counters_restart_at_the_gap(txns):
    start = dt.datetime(2026, 1, 1, 0, 50)
    minutes = [0, 59, 119, 178, 179]  # the third comes exactly one hour after the second
    rows = entity_rows(txns([{"event_timestamp": start + dt.timedelta(minutes=m)} for m in minutes]), {"customer": "customer_id"})
    got = ES.gap_counters(rows, 3_600_000_000).orderBy("session").collect()
    assert [r["txn_count"] for r in got] == [2, 3]


def test_context_of_unknown_entities_is_null(txns):
    state = ES.snapshot(txns([{}, {}]))
    row = ES.transaction_context(txns([{"customer_id": "new"}]), state, ["txn_count"]).first()
    assert row["customer_txn_count"] is None and row["card_txn_count"] == 2


# ── files ──


def test_csv_round_trip_and_errors(spark, txns, tmp_path):
    df = txns([{"customer_country": "NA"}, {"amount": 2.5}])
    df.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(df).count() == 0 and back.count() == 2
    narrow = read_csv(spark, str(tmp_path / "csv"), ["transaction_id", "amount"], 1)
    assert narrow.columns == ["transaction_id", "amount"] and narrow.count() == 1
    assert dict(read_csv(spark, str(tmp_path / "csv"), parse_dates=False).dtypes)["event_timestamp"] == "string"
    with pytest.raises(DatasetNotFoundError):
        read_csv(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "csv"), ["other"])


def test_fingerprint_marks_nulls_and_edges(txns):
    of = lambda a, b: Q.fingerprint(txns([{"customer_id": a, "account_id": b}]), ["customer_id", "account_id"]).first()
    assert len({of(None, "x"), of("", "x"), of("x", None), of("1:x", ""), of("x", "x")}) == 5


def test_canonical_layout_prunes_days(spark, txns, tmp_path):
    write_table(txns([{} for _ in range(60)]), str(tmp_path / "t"))
    df = read_parquet(spark, str(tmp_path / "t")).where("event_date = '2026-01-02'")
    assert df.count() == 24
    assert "PartitionFilters: [isnotnull(event_date" in df._jdf.queryExecution().executedPlan().toString()


def test_features_with_few_values_are_reported_as_skipped(spark):
    base = spark.createDataFrame([(float(i), None if i > 3 else 1.0) for i in range(50)], "a double, b double")
    found = {(r.feature, r.metric): r for r in D.check_drift(base, base, ["a", "b"]).collect()}
    assert found["a", "psi"].severity == "none" and found["b", "ks"].severity == "skipped" and found["b", "psi"].value is None and len(found) == 4
    assert D.drift_summary(D.check_drift(base, base, ["a", "b"])).first().checks == 2


def test_gates_take_their_evidence_from_results(spark):
    from riskflow.operators import gates as G

    better = spark.createDataFrame([("raw", 0.2), ("platt", 0.1), ("isotonic", 0.3)], "method string, brier double")
    worse = spark.createDataFrame([("raw", 0.1), ("platt", 0.1)], "method string, brier double")
    base = spark.createDataFrame([(float(i),) for i in range(100)], "a double")
    moved = spark.createDataFrame([(float(i + 80),) for i in range(100)], "a double")
    assert G.promotion_evidence(better, D.check_drift(base, base, ["a"]), ["log_amount"]) == {"has_calibration": True, "has_drift": False, "has_leakage": False}
    assert G.promotion_evidence(worse, D.check_drift(base, moved, ["a"]), ["true_fraud_label"]) == {"has_calibration": False, "has_drift": True, "has_leakage": True}


def test_context_keeps_rows_that_share_an_id_or_have_no_key(spark, txns):
    start = dt.datetime(2026, 1, 1)
    keys = [f"{e}_id" for e in ("customer", "account", "card", "merchant", "device", "ip")]
    at = lambda h: start + dt.timedelta(hours=h)
    rows = L.strip_labels(txns([
        {"transaction_id": "a", "event_timestamp": at(1)}, {"transaction_id": "a", "event_timestamp": at(3)}, {"transaction_id": "a", "event_timestamp": at(3)},
        {"transaction_id": "b", "event_timestamp": at(2), **dict.fromkeys(keys)}, {"transaction_id": None, "event_timestamp": at(5)}]))
    rows = rows.withColumn("transaction_sequence_id", F.lit(7))
    key = rows.where("card_id IS NOT NULL").first()["card_id"]
    us = lambda h: int(at(h).replace(tzinfo=dt.UTC).timestamp() * 1e6)
    versions = spark.createDataFrame([("card", key, us(2), 0, 1.5), ("card", key, us(3), 0, 2.5), ("card", key, us(3), 9, 3.5), ("card", key, us(9), 0, 9.5), ("card", "other", us(0), 0, 0.5)],
                                     "entity string, entity_id string, us long, seq long, value double")
    found = sorted(((r.transaction_id or "", r.us, r.card_value, r.customer_value) for r in ES.context_as_of(rows, versions, ["value"]).collect()))
    assert found == sorted([("a", us(1), None, None), ("a", us(3), 3.5, None), ("a", us(3), 3.5, None), ("b", us(2), None, None), ("", us(5), 3.5, None)])
    state = spark.createDataFrame([("card", key, 4)], "entity string, entity_id string, n long")
    latest = [(r.transaction_id or "", r.card_n) for r in ES.transaction_context(rows, state, ["n"]).collect()]
    assert sorted(latest, key=repr) == sorted([("a", 4), ("a", 4), ("a", 4), ("b", None), ("", 4)], key=repr)
