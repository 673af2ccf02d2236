"""Guards that keep post-event columns away from features (LKG1-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.schema import EXCLUDED, FORBIDDEN, ID_COLUMNS


class LeakageError(ValueError):
    def __init__(self, columns: Sequence[str]) -> None:
        self.columns = list(columns)
        super().__init__(f"post-event columns are not available at decision time: {self.columns}")


def assert_no_leakage(df: DataFrame | Sequence[str], forbidden: Sequence[str] = FORBIDDEN) -> None:
    """LKG1, LKG5: compares names only, runs no job."""
    names = df.columns if isinstance(df, DataFrame) else list(df)
    found = [c for c in forbidden if c in names]
    if found:
        raise LeakageError(found)


def record_leaks(keys: Column, forbidden: Sequence[str] = FORBIDDEN) -> Column:
    """LKG2: true when a record's keys contain a forbidden one."""
    return F.arrays_overlap(keys, F.array(*[F.lit(c) for c in forbidden]))


def safe_columns(columns: Sequence[str]) -> list[str]:
    """LKG3: columns that may serve as model inputs, in the given order."""
    unsafe = {*FORBIDDEN, *EXCLUDED, *ID_COLUMNS}
    return [c for c in columns if c not in unsafe]


def strip_labels(df: DataFrame) -> DataFrame:
    """LKG4."""
    return df.drop(*FORBIDDEN)


def future_changes_past(full: DataFrame, truncated: DataFrame, row_id: str = "transaction_id") -> DataFrame:
    """LKG6: rows of ``truncated`` (features computed without the future) that differ
    from ``full``; empty when no feature looks ahead."""
    cols = truncated.columns
    return truncated.exceptAll(full.select(*cols).join(truncated.select(row_id), row_id, "left_semi").select(*cols))
