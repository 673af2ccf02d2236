"""Chronological splits (SPL1-4) and column alignment (SPL7-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.config import SplitBounds


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def assign_split(df: DataFrame, bounds: SplitBounds, ts: str = "event_timestamp") -> DataFrame:
    """Add ``split`` (TRAIN, VAL, TEST, GAP) and ``subsplit`` (VAL_CALIB, VAL_OPT or the split).

    Bounds are inclusive whole seconds, so an instant inside the last second of a
    split belongs to none of them and is labelled GAP instead of disappearing.
    """
    t = F.col(ts)
    in_val = (t >= _ts(bounds.val_start)) & (t <= _ts(bounds.val_end))
    split = (
        F.when(t <= _ts(bounds.train_end), "TRAIN")
        .when(in_val, "VAL")
        .when(t >= _ts(bounds.test_start), "TEST")
        .otherwise("GAP")
    )
    subsplit = (
        F.when(in_val & (t <= _ts(bounds.val_calib_end)), "VAL_CALIB")
        .when(in_val & (t >= _ts(bounds.val_opt_start)), "VAL_OPT")
        .when(in_val, "GAP")
    )
    return df.withColumn("split", split).withColumn("subsplit", F.coalesce(subsplit, F.col("split")))


def split_distribution(df: DataFrame, by: str = "subsplit", label: str = "true_fraud_label") -> DataFrame:
    """SPL4: rows, fraud and fraud percentage per split."""
    fraud = F.sum(F.col(label).cast("bigint"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        fraud.alias("n_fraud"),
        (fraud / F.count(F.lit(1)) * 100.0).alias("fraud_pct"),
    )


def split_overlaps(df: DataFrame, bounds: SplitBounds, ts: str = "event_timestamp") -> DataFrame:
    """SPL3: rows that satisfy more than one split's condition, and rows that satisfy none."""
    t = F.col(ts)
    inside = [
        t <= _ts(bounds.train_end),
        (t >= _ts(bounds.val_start)) & (t <= _ts(bounds.val_calib_end)),
        (t >= _ts(bounds.val_opt_start)) & (t <= _ts(bounds.val_end)),
        t >= _ts(bounds.test_start),
    ]
    hits = sum((c.cast("int") for c in inside[1:]), inside[0].cast("int"))
    return df.agg(F.count_if(hits > 1).alias("n_overlap"), F.count_if(hits == 0).alias("n_gap"))


def common_columns(*frames: DataFrame) -> list[str]:
    """SPL7: columns present everywhere, sorted."""
    shared = set(frames[0].columns)
    for f in frames[1:]:
        shared &= set(f.columns)
    return sorted(shared)


def align_to(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """SPL8: exactly ``names`` in that order as doubles; absent, null, NaN and infinite become 0."""

    def one(name: str) -> Column:
        if name not in df.columns:
            return F.lit(0.0).alias(name)
        c = F.col(name).cast("double")
        bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(bad, F.lit(0.0)).otherwise(c).alias(name)

    return df.select(*keep, *[one(n) for n in names])
