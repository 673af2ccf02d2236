import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow.functions.scalar import SCALAR, feature_columns


def values(df, name):
    return [r[0] for r in df.orderBy("transaction_id").select(SCALAR[name]()).collect()]


@pytest.mark.parametrize(
    "feature, column, given, expected",
    [
        ("is_new_device", "device_age_days", [1, 7, 30, 365, None], [1, 0, 0, 0, 0]),
        ("is_proxy", "proxy_type", ["none", "proxy", "tor", "unknown", None], [0, 1, 1, 0, 0]),
        ("is_tor", "proxy_type", ["none", "proxy", "TOR_exit", "unknown", None], [0, 0, 1, 0, 0]),
        ("proxy_risk_score", "proxy_type", ["none", "unknown", "proxy", "TOR_exit", None], [0, 1, 2, 3, 0]),
        ("is_datacenter", "connection_type", ["Datacenter", "mobile", None], [1, 0, 0]),
        ("amount_bucket", "amount", [0.5, 1, 1.01, 10, 5000, 5000.01, -3, None], [0, 0, 1, 1, 6, 7, 0, 0]),
        ("customer_tenure_bucket", "customer_tenure_days", [-1, 0, 30, 31, 730, 731, None], [0, 0, 0, 1, 3, 4, 0]),
        ("device_age_bucket", "device_age_days", [7, 8, 30, 31, 365, 366], [0, 1, 1, 2, 3, 4]),
        ("is_micro_txn", "amount", [0.99, 1.0, None], [1, 0, 0]),
        ("is_high_value_txn", "amount", [5000.0, 5000.01], [0, 1]),
    ],
)
def test_vectors(txns, feature, column, given, expected):
    assert values(txns([{column: v} for v in given]), feature) == expected


def test_amount_ratio_limits_and_zero_limit(txns):
    df = txns([{"amount": 50.0, "credit_limit": 0.0}, {"amount": -5.0, "credit_limit": 10.0}, {"amount": 1e6, "credit_limit": 10.0}])
    assert values(df, "amount_credit_ratio") == [50.0, 0.0, 100.0]


def test_country_mismatch_counts_missing_sides(txns):
    df = txns([
        {"customer_country": None, "transaction_country": "US"},
        {"customer_country": "US", "transaction_country": None},
        {"customer_country": None, "transaction_country": None},
        {"customer_country": "US", "transaction_country": "US"},
    ])
    assert values(df, "customer_txn_country_mismatch") == [1, 1, 1, 0]


def test_geo_count_none_and_all(txns):
    parties = ["customer", "billing", "card", "device", "ip", "merchant"]
    other = dict(zip((f"{p}_country" for p in parties), ["UK", "DE", "FR", "NG", "JP", "BR"]))
    assert values(txns([{}, other]), "geo_mismatch_count") == [0, 6]


def test_time_features(txns):
    df = txns([{"event_timestamp": dt.datetime(2026, 1, 3, 22, 47, 1)}])  # a Saturday
    row = df.select(*feature_columns(["hour_of_day", "minute_bucket", "day_of_week", "day_of_month", "is_weekend", "is_night"])).first()
    assert tuple(row) == (22, 91, 5, 3, 1, 1)


def test_no_nulls_in_binary_flags(txns):
    df = txns([{c: None for c in ("proxy_type", "connection_type", "device_age_days", "amount")}])
    flags = [n for n in SCALAR if n.startswith("is_") and n not in ("is_international", "is_installment")]
    assert df.select(*feature_columns(flags)).where(" OR ".join(f"{f} IS NULL" for f in flags)).count() == 0
    assert df.select(F.lit(1)).count() == 1
