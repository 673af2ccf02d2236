"""Row-wise features F1-F21: one expression per feature, used by batch and stream alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskflow.functions.buckets import bucket

# Bucket edges (right-closed).
AMOUNT_EDGES = [1.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 5000.0]
TENURE_EDGES = [30, 90, 365, 730]
DEVICE_AGE_EDGES = [7, 30, 90, 365]

COUNTRY_PARTIES = ["customer", "billing", "card", "device", "ip", "merchant"]


def flag(condition: Column) -> Column:
    """1 when true; 0 when false or unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def _age_bucket(name: str, edges: list[int]) -> Column:
    return F.coalesce(bucket(F.col(name), edges, right_closed=True), F.lit(0))


def country_mismatch(party: str) -> Column:
    """A missing country on either side counts as a mismatch."""
    return F.coalesce(F.col(f"{party}_country") != F.col("transaction_country"), F.lit(True)).cast("int")


def _proxy() -> Column:
    return F.lower(F.coalesce(F.col("proxy_type"), F.lit("none")))


def _is_tor() -> Column:
    return F.contains(_proxy(), F.lit("tor"))


def _weekday() -> Column:
    return F.weekday("event_timestamp")


def _geo_count() -> Column:
    total = country_mismatch(COUNTRY_PARTIES[0])
    for party in COUNTRY_PARTIES[1:]:
        total = total + country_mismatch(party)
    return total


STATIC: dict[str, Callable[[], Column]] = {
    "log_amount": lambda: F.log1p(F.greatest(F.col("amount"), F.lit(0.0))),
    "amount_credit_ratio": lambda: F.least(
        F.greatest(
            F.col("amount") / F.when(F.col("credit_limit") == 0, F.lit(1.0)).otherwise(F.col("credit_limit")),
            F.lit(0.0),
        ),
        F.lit(100.0),
    ),
    "is_international": lambda: F.col("international_flag").cast("int"),
    "is_installment": lambda: F.col("installment_flag").cast("int"),
    "amount_bucket": lambda: F.coalesce(bucket(F.col("amount"), AMOUNT_EDGES, right_closed=True), F.lit(0)),
    "is_micro_txn": lambda: flag(F.col("amount") < 1.0),
    "is_high_value_txn": lambda: flag(F.col("amount") > 5000.0),
    "customer_tenure_bucket": lambda: _age_bucket("customer_tenure_days", TENURE_EDGES),
    "card_age_bucket": lambda: _age_bucket("card_age_days", TENURE_EDGES),
    "device_age_bucket": lambda: _age_bucket("device_age_days", DEVICE_AGE_EDGES),
}

TEMPORAL: dict[str, Callable[[], Column]] = {
    "hour_of_day": lambda: F.hour("event_timestamp"),
    "minute_bucket": lambda: F.hour("event_timestamp") * 4 + F.floor(F.minute("event_timestamp") / 15).cast("int"),
    "day_of_week": _weekday,
    "day_of_month": lambda: F.dayofmonth("event_timestamp"),
    "is_weekend": lambda: flag(_weekday() >= 5),
    "is_night": lambda: flag((F.hour("event_timestamp") >= 22) | (F.hour("event_timestamp") < 7)),
}

GEOGRAPHIC: dict[str, Callable[[], Column]] = {
    **{f"{party}_txn_country_mismatch": (lambda party=party: country_mismatch(party)) for party in COUNTRY_PARTIES},
    "geo_mismatch_count": _geo_count,
    "cross_border_flag": lambda: country_mismatch("customer"),
}

IDENTITY: dict[str, Callable[[], Column]] = {
    "is_new_device": lambda: flag(F.col("device_age_days") < 7),
    "is_proxy": lambda: flag(~_proxy().isin("none", "unknown")),
    "is_tor": lambda: flag(_is_tor()),
    "is_datacenter": lambda: flag(F.contains(F.lower("connection_type"), F.lit("datacenter"))),
    "proxy_risk_score": lambda: (
        F.when(_is_tor(), 3).when(~_proxy().isin("none", "unknown"), 2).when(_proxy() != "none", 1).otherwise(0)
    ),
}

SCALAR: dict[str, Callable[[], Column]] = {**STATIC, **TEMPORAL, **GEOGRAPHIC, **IDENTITY}


def feature_columns(names: list[str]) -> list[Column]:
    return [SCALAR[n]().alias(n) for n in names]


def sanitised(name: str, dtype: str) -> Column:
    """null, NaN and ±infinity become 0."""
    c = F.col(name)
    if dtype in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c).alias(name)
    return F.coalesce(c, F.lit(0).cast(dtype)).alias(name)
