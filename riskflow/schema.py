"""The fixed transactions schema and the column lists derived from it."""

from __future__ import annotations

from pyspark.sql import types as T

# The 54 columns in canonical order with their Spark types.
_COLUMNS = """
transaction_id string
event_timestamp timestamp
transaction_sequence_id bigint
event_version string
customer_id string
customer_tenure_days int
account_id string
account_type string
customer_country string
customer_risk_segment string
card_id string
card_type string
card_age_days int
credit_limit double
card_country string
card_status string
merchant_id string
merchant_category string
merchant_country string
merchant_region string
merchant_size string
merchant_age_days int
merchant_risk_segment string
device_id string
device_type string
device_os string
device_age_days int
device_country string
device_trust_level string
ip_id string
ip_country string
connection_type string
network_risk_segment string
proxy_type string
amount double
currency string
transaction_type string
payment_channel string
payment_method string
authentication_method string
installment_flag int
international_flag int
transaction_country string
billing_country string
terminal_id string
branch_id string
processing_route string
settlement_type string
batch_window string
is_outlier int
true_fraud_label int
observed_label int
label_timestamp timestamp
fraud_scenario string
"""

_PAIRS = [tuple(line.split()) for line in _COLUMNS.strip().splitlines()]
_TYPES = {
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
}

# Columns known only after the event; never an input of a model.
FORBIDDEN = ["true_fraud_label", "fraud_scenario", "observed_label", "label_timestamp"]
# Quality metadata, not a feature.
EXCLUDED = ["is_outlier"]
# Identifiers, used for grouping only.
ID_COLUMNS = [
    "transaction_id",
    "event_timestamp",
    "transaction_sequence_id",
    "event_version",
    "customer_id",
    "account_id",
    "card_id",
    "device_id",
    "ip_id",
    "merchant_id",
    "terminal_id",
    "branch_id",
]

COLUMNS: list[str] = [name for name, _ in _PAIRS]
ONLINE_COLUMNS: list[str] = [c for c in COLUMNS if c not in FORBIDDEN]
NUMERIC_COLUMNS: list[str] = [name for name, kind in _PAIRS if kind in ("bigint", "int", "double")]
TYPE_OF: dict[str, str] = dict(_PAIRS)

TXN = T.StructType([T.StructField(n, _TYPES[k], True) for n, k in _PAIRS])
TXN_ONLINE = T.StructType([f for f in TXN.fields if f.name in ONLINE_COLUMNS])

# Low-cardinality columns that are frequency-encoded.
CATEGORICAL = [
    "account_type",
    "card_type",
    "merchant_category",
    "merchant_size",
    "transaction_type",
    "payment_channel",
    "payment_method",
    "authentication_method",
    "connection_type",
    "proxy_type",
    "device_type",
    "device_os",
    "card_status",
    "device_trust_level",
    "currency",
    "settlement_type",
    "processing_route",
    "customer_risk_segment",
    "merchant_risk_segment",
    "network_risk_segment",
]

# Defaults of a sparse scoring request; fields absent here are required.
REQUEST_DEFAULTS: dict[str, object] = {
    "transaction_sequence_id": 0,
    "event_version": "v2.1",
    "customer_tenure_days": 0,
    "account_type": "CREDIT",
    "customer_country": "US",
    "customer_risk_segment": "LOW",
    "card_type": "CREDIT",
    "card_age_days": 0,
    "credit_limit": 5000.0,
    "card_country": "US",
    "card_status": "ACTIVE",
    "merchant_category": "RETAIL",
    "merchant_country": "US",
    "merchant_region": "REG_US_01",
    "merchant_size": "MEDIUM",
    "merchant_age_days": 365,
    "merchant_risk_segment": "LOW",
    "device_type": "MOBILE_ANDROID",
    "device_os": "Android_14",
    "device_age_days": 100,
    "device_country": "US",
    "device_trust_level": "MEDIUM",
    "ip_country": "US",
    "connection_type": "residential",
    "network_risk_segment": "CLEAN",
    "proxy_type": "none",
    "currency": "USD",
    "transaction_type": "purchase",
    "payment_channel": "WEB",
    "payment_method": "CARD_PRESENT",
    "authentication_method": "PIN",
    "installment_flag": 0,
    "international_flag": 0,
    "transaction_country": "US",
    "billing_country": "US",
    "terminal_id": "TERM_0001",
    "branch_id": "BR_001",
    "processing_route": "ROUTE_A",
    "settlement_type": "INSTANT",
    "batch_window": "BATCH_00",
    "is_outlier": 0,
}
REQUIRED_REQUEST = [c for c in ONLINE_COLUMNS if c not in REQUEST_DEFAULTS]
