"""How many tasks a step takes, by its rows: a stored file's size says little about them once they are decoded and exploded."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of one task, about, where a step sorts, buffers or aggregates rows of its own.
TASK_ROWS = 500_000


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks for ``rows`` rows; never fewer than run at once."""
    return max(-(-rows // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
