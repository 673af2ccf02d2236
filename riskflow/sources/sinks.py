"""Batch sinks: chronological feed, audit trail, experiment tables (SNK4-6)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.config import TOPIC_RAW
from riskflow.operators.leakage import strip_labels
from riskflow.sources.kafka import messages

AUDIT_SCHEMA = (
    "transaction_id string, request_id string, model_version string, fraud_probability double, "
    "risk_score int, decision string, latency_ms double, scored_at timestamp"
)


def label_free_feed(df: DataFrame, limit: int | None = None) -> DataFrame:
    """SNK4: history without labels, in time order, as raw-topic messages.

    The sort is a range-partitioned one, so its output files are in global order. A
    limit keeps the earliest rows.
    """
    ordered = strip_labels(df).orderBy("event_timestamp", "transaction_id")
    return messages(ordered if limit is None else ordered.limit(limit), TOPIC_RAW)


def audit_rows(scored: DataFrame, model_version: str, request_id: str | None = None, latency: str | None = None) -> DataFrame:
    """SNK5: one audit record per scored transaction."""
    request = F.col(request_id) if request_id else F.sha2(F.concat_ws("|", F.lit(model_version), F.col("transaction_id")), 256).substr(1, 32)
    took = F.col(latency).cast("double") if latency else F.lit(None).cast("double")
    return scored.select(
        "transaction_id",
        request.alias("request_id"),
        F.lit(model_version).alias("model_version"),
        F.round("fraud_probability", 6).alias("fraud_probability"),
        "risk_score",
        "decision",
        F.round(took, 2).alias("latency_ms"),
        F.current_timestamp().alias("scored_at"),
    )


def append_audit(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """SNK5: audit records by day. With the number of a micro-batch its records go to a folder of their own, which the same micro-batch, repeated on whatever day, overwrites."""
    dated = rows.withColumn("scored_date", F.to_date("scored_at")).write.partitionBy("scored_date")
    if batch_id is None:
        dated.mode("append").parquet(path)
    else:
        dated.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def experiment_rows(spark: SparkSession, results: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """SNK6: experiment comparison, one row per model."""
    columns = sorted({k for r in results.values() for k in r})
    rows = [(name, *[None if r.get(c) is None else float(r[c]) for c in columns]) for name, r in results.items()]
    return spark.createDataFrame(rows, ", ".join(["model string", *[f"{c} double" for c in columns]]))


def manifest_row(spark: SparkSession, manifest: Mapping[str, object], features: Sequence[str]) -> DataFrame:
    """SNK6: the production manifest as one row; free-form entries as JSON text."""
    return spark.createDataFrame(
        [(str(manifest["model_name"]), str(manifest["model_version"]), list(features), json.dumps(dict(manifest), sort_keys=True, default=str))],
        "model_name string, model_version string, feature_names array<string>, manifest string",
    )
