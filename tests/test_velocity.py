import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.operators import velocity as V
from riskflow.operators.encode import FrequencyEncoder
from riskflow.plans.features import feature_table
from riskflow.operators.leakage import future_changes_past

START = dt.datetime(2026, 1, 1)


def random_rows(n, seed=1, hot=0.5):
    """Heavy ties, and one merchant with a large share of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append({
            "event_timestamp": START + dt.timedelta(minutes=5 * rng.randrange(0, 3000)),
            "transaction_sequence_id": i,
            "customer_id": f"C{rng.randrange(5)}",
            "merchant_id": "HOT" if rng.random() < hot else f"M{rng.randrange(4)}",
            "amount": rng.choice([10.0, 10.0, rng.uniform(0, 500)]),
        })
    return rows


def brute(rows, key):
    """Every definition spelled out over Python lists."""
    ordered = sorted(enumerate(rows), key=lambda p: (p[1]["event_timestamp"], p[1]["transaction_sequence_id"]))
    past, out = {}, {}
    for i, r in ordered:
        before = past.setdefault(r[key], [])
        t = r["event_timestamp"]
        res = {"n": len(before), "avg": sum(b["amount"] for b in before) / len(before) if before else 0.0}
        res["std"] = statistics.stdev([b["amount"] for b in before]) if len(before) > 1 else 0.0
        res["gap"] = (t - before[-1]["event_timestamp"]).total_seconds() if before else -1.0
        for w, us in WINDOWS_US.items():
            inside = [b["amount"] for b in before if b["event_timestamp"] >= t - dt.timedelta(microseconds=us)]
            res[f"n_{w}"], res[f"s_{w}"] = len(inside), sum(inside)
        out[f"T{i:05d}"] = res
        before.append(r)
    return out


@pytest.mark.parametrize("strategy, limit", [("windows", None), ("totals", None), ("auto", 40)])
def test_against_brute_force(txns, strategy, limit):
    rows = random_rows(200)
    df = txns(rows)
    got = V.velocity(df, {"customer": "customer_id", "merchant": "merchant_id"}, WINDOWS_US, strategy=strategy, limit=limit).collect()
    assert len(got) == len(rows)
    for entity in ("customer", "merchant"):
        want = brute(rows, f"{entity}_id")
        for g in got:
            w = want[g["transaction_id"]]
            assert g[f"{entity}_total_txn_count"] == w["n"]
            assert math.isclose(g[f"{entity}_avg_amount"], w["avg"], abs_tol=1e-6)
            assert math.isclose(g[f"{entity}_std_amount"], w["std"], abs_tol=1e-6)
            assert g[f"time_since_prev_{entity}_txn_seconds"] == w["gap"]
            for k in WINDOWS_US:
                assert g[f"{entity}_txn_count_{k}"] == w[f"n_{k}"], k
                assert math.isclose(g[f"{entity}_amount_sum_{k}"], w[f"s_{k}"], abs_tol=1e-6)


def test_window_start_is_inclusive_and_ties_follow_order(txns):
    at = [START, START, START + dt.timedelta(minutes=5), START + dt.timedelta(minutes=5, seconds=1)]
    df = txns([{"event_timestamp": t} for t in at])
    for strategy in ("windows", "totals"):
        out = V.velocity(df, {"customer": "customer_id"}, {"5m": WINDOWS_US["5m"]}, prior=False, strategy=strategy)
        assert [r["customer_txn_count_5m"] for r in out.orderBy("transaction_id").collect()] == [0, 1, 2, 1]


def test_all_rows_of_one_key_at_one_instant(txns):
    df = txns([{"event_timestamp": START, "amount": 3.0} for _ in range(50)])
    out = V.velocity(df, {"merchant": "merchant_id"}, {"1h": WINDOWS_US["1h"]}, strategy="totals").orderBy("transaction_id").collect()
    assert [r["merchant_txn_count_1h"] for r in out] == list(range(50))
    assert all(r["merchant_std_amount"] == 0.0 for r in out)
    assert out[-1]["amount_zscore_merchant"] == 0.0


def test_first_row_has_no_past(txns):
    row = V.velocity(txns([{}]), ENTITIES, WINDOWS_US).first().asDict()
    for e in ENTITIES:
        assert row[f"{e}_total_txn_count"] == 0 and row[f"{e}_std_amount"] == 0.0
        assert row[f"time_since_prev_{e}_txn_seconds"] == -1.0
        assert row[f"amount_zscore_{e}"] == 10.0  # 100 over a unit spread, clipped


def test_missing_entity_key_has_no_history(txns):
    out = V.velocity(txns([{"device_id": None}, {"device_id": None}]), ENTITIES, None).collect()
    assert len(out) == 2 and all(r["device_total_txn_count"] == 0 for r in out)
    assert all(r["time_since_prev_device_txn_seconds"] == -1.0 for r in out)


@pytest.mark.parametrize("cut", [30, 77, 150])
def test_future_does_not_change_the_past(txns, cut):
    df = txns(random_rows(160, seed=3))
    limit = sorted(r["event_timestamp"] for r in random_rows(160, seed=3))[min(cut, 159)]
    past = df.where(F.col("event_timestamp") <= F.lit(limit))
    args = ({"customer": "customer_id"}, WINDOWS_US)
    assert future_changes_past(V.velocity(df, *args), V.velocity(past, *args)).count() == 0


def test_history_is_told_by_tag_not_position(txns):
    df = txns(random_rows(120, seed=5))
    target, history = df.where("transaction_sequence_id % 3 = 0"), df.where("transaction_sequence_id % 3 <> 0")
    entities = {"customer": "customer_id"}
    with_history = V.velocity(target, entities, WINDOWS_US, history=history)
    whole = V.velocity(df, entities, WINDOWS_US).join(target.select("transaction_id"), "transaction_id", "left_semi")
    assert with_history.count() == target.count()
    assert with_history.exceptAll(whole.select(with_history.columns)).count() == 0


def test_no_row_is_lost(txns):
    keys = {c: None for c in ENTITIES.values()}
    df = txns([{**keys, "transaction_id": "A"}, {**keys, "transaction_id": "B"}, {"transaction_id": "C"}, {"transaction_id": "C"}, {"transaction_id": None}])
    for strategy in ("windows", "totals"):
        out = V.velocity(df, ENTITIES, WINDOWS_US, strategy=strategy).collect()
        assert sorted((r.transaction_id or "", r.customer_total_txn_count) for r in out) == [("", 2), ("A", 0), ("B", 0), ("C", 0), ("C", 1)]
        assert all(r.time_since_prev_card_txn_seconds == -1 for r in out if r.transaction_id in ("A", "B"))


def test_feature_table_keeps_rows_that_share_an_id(txns):
    df = txns([{"transaction_id": "C", "amount": 10.0 + i} for i in range(3)])
    out = feature_table(df, FrequencyEncoder.fit(df)).collect()
    assert sorted(r.customer_total_txn_count for r in out) == [0, 1, 2]
