"""Parameters with their defaults; every operator accepts an override."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SplitBounds:
    """Inclusive time bounds of the chronological splits, as ISO text."""

    train_end: str
    val_start: str
    val_calib_end: str
    val_opt_start: str
    val_end: str
    test_start: str


# Fixed values.
@dataclass(frozen=True)
class RiskBands:
    """Upper bounds (inclusive) of the score bands; above the last is CRITICAL or BLOCK."""

    max_score: int = 1000
    low_max: int = 199
    medium_max: int = 499
    high_max: int = 749
    approve_max: int = 299
    review_max: int = 699


# Fixed values.
@dataclass(frozen=True)
class Costs:
    avg_fraud_loss: float = 500.0
    false_positive: float = 25.0
    manual_review: float = 5.0


# Fixed values.
@dataclass(frozen=True)
class DriftLevels:
    """metric -> (warning, critical)."""

    psi: tuple[float, float] = (0.1, 0.2)
    ks: tuple[float, float] = (0.05, 0.1)
    js: tuple[float, float] = (0.05, 0.1)


# Fixed values.
@dataclass(frozen=True)
class GateLimits:
    min_pr_auc: float = 0.30
    min_recall: float = 0.70
    max_fpr: float = 0.10
    max_expected_cost: float = 100_000.0
    max_brier: float = 0.05
    require_calibration: bool = True
    require_no_drift: bool = True
    require_no_leakage: bool = True


# Fixed values.
@dataclass(frozen=True)
class RetrainLimits:
    pr_auc_drop: float = 0.05
    recall_drop: float = 0.1
    drift_pr_auc_drop: float = 0.02
    drift_recall_drop: float = 0.05


@dataclass(frozen=True)
class DatasetExpectation:
    """What a delivered table must look like (quality checks)."""

    row_count: int = 0
    fraud_count: int | None = None
    observed_count: int | None = None
    outlier_count: int | None = None
    timestamp_min: str = "2026-01-01"
    timestamp_max: str = "2026-06-30"
    fingerprint: str | None = None


# The published split of the original half-year table.
HALF_YEAR_2026 = SplitBounds(
    train_end="2026-04-30 23:59:59",
    val_start="2026-05-01 00:00:00",
    val_calib_end="2026-05-15 23:59:59",
    val_opt_start="2026-05-16 00:00:00",
    val_end="2026-05-31 23:59:59",
    test_start="2026-06-01 00:00:00",
)

# Split of the supplied 30-day events table.
JANUARY_2024 = SplitBounds(
    train_end="2024-01-20 23:59:59",
    val_start="2024-01-21 00:00:00",
    val_calib_end="2024-01-22 23:59:59",
    val_opt_start="2024-01-23 00:00:00",
    val_end="2024-01-25 23:59:59",
    test_start="2024-01-26 00:00:00",
)

# Rolling windows: label -> microseconds.
MINUTE_US = 60_000_000
WINDOWS_US: dict[str, int] = {
    "5m": 5 * MINUTE_US,
    "15m": 15 * MINUTE_US,
    "1h": 60 * MINUTE_US,
    "6h": 6 * 60 * MINUTE_US,
    "24h": 24 * 60 * MINUTE_US,
    "7d": 7 * 24 * 60 * MINUTE_US,
}

# Entity name -> key column, in the order features are emitted.
ENTITIES: dict[str, str] = {
    "customer": "customer_id",
    "card": "card_id",
    "device": "device_id",
    "ip": "ip_id",
    "merchant": "merchant_id",
    "account": "account_id",
}

# Default operating thresholds of the metric curve.
CURVE_THRESHOLDS: tuple[float, ...] = (0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

# Stream topics.
TOPIC_RAW = "transactions.raw"
TOPIC_VALIDATED = "transactions.validated"
TOPIC_SCORED = "transactions.scored"
TOPIC_ALERTS = "fraud.alerts"
TOPIC_REVIEW = "fraud.review"
TOPIC_BLOCKED = "fraud.blocked"
TOPIC_MODEL_EVENTS = "model.events"
TOPIC_DEAD_LETTER = "dead_letter.transactions"
