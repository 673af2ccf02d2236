"""Frequency encoding fitted on training rows only (ENC1-3)."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskflow.schema import CATEGORICAL

# A column with more values than this is looked up by a join; literal maps stay small.
MAP_LIMIT = 200


def frequency_table(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """ENC1: ``(col, val, n, freq)``; nulls count neither as a value nor in the denominator."""
    present = [c for c in columns if c in df.columns]
    counts = (
        df.select(*[F.col(c).cast("string").alias(c) for c in present])
        .unpivot([], present, "col", "val")
        .where("val IS NOT NULL")
        .groupBy("col", "val")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("col").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_values"))
    # One row per encoded column.
    return counts.join(F.broadcast(totals), "col").select("col", "val", "n", (F.col("n") / F.col("total")).alias("freq"), "n_values")


@dataclass
class FrequencyEncoder:
    """Fitted frequencies: small columns as maps, large ones as a table to join."""

    columns: list[str]
    maps: dict[str, dict[str, float]] = field(default_factory=dict)
    table: DataFrame | None = None
    joined: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str] = CATEGORICAL, map_limit: int = MAP_LIMIT) -> FrequencyEncoder:
        present = [c for c in columns if c in train.columns]
        table = frequency_table(train, present).persist()
        small = F.col("n_values") <= map_limit
        # Bounded: at most map_limit rows for each encoded column.
        maps: dict[str, dict[str, float]] = {c: {} for c in present}
        for row in table.where(small).select("col", "val", "freq").collect():
            maps[row["col"]][row["val"]] = row["freq"]
        large = [r["col"] for r in table.where(~small).select("col").distinct().collect()]
        if not large:
            table.unpersist()
            return cls(present, maps)
        return cls(present, {c: m for c, m in maps.items() if c not in large}, table, sorted(large))

    def _mapped(self, name: str) -> Column:
        # Values in a fixed order, so that equal encoders make equal plans.
        pairs = [F.lit(x) for kv in sorted(self.maps[name].items()) for x in kv]
        if not pairs:
            return F.lit(0.0)
        return F.coalesce(F.create_map(*pairs)[F.col(name).cast("string")], F.lit(0.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """ENC2: add ``<col>_encoded``; a value unseen in training is 0."""
        mapped = [c for c in self.columns if c in df.columns and c not in self.joined]
        out = df.select("*", *[self._mapped(c).alias(f"{c}_encoded") for c in mapped])
        for c in self.joined:
            if c not in df.columns:
                continue
            freq = self.table.where(F.col("col") == c).select(
                F.col("val").alias(f"_val_{c}"), F.col("freq").alias(f"_freq_{c}")
            )
            out = (
                out.join(freq, F.col(c).cast("string") == F.col(f"_val_{c}"), "left")
                .withColumn(f"{c}_encoded", F.coalesce(F.col(f"_freq_{c}"), F.lit(0.0)))
                .drop(f"_val_{c}", f"_freq_{c}")
            )
        return out


def encode_with_own_frequencies(df: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """ENC3: frequencies of the passed frame itself; not for training or evaluation."""
    warnings.warn("frequencies come from the encoded rows themselves", stacklevel=2)
    return FrequencyEncoder.fit(df, columns).transform(df)
