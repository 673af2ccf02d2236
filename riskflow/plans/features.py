"""The full feature table (VEL9): 49 columns, 79 with history, or with exact windows on top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.functions.scalar import GEOGRAPHIC, IDENTITY, STATIC, TEMPORAL, feature_columns, sanitised
from riskflow.operators.encode import FrequencyEncoder
from riskflow.operators.leakage import assert_no_leakage
from riskflow.operators.velocity import feature_names, velocity
from riskflow.schema import CATEGORICAL

ENCODED = [f"{c}_encoded" for c in CATEGORICAL]
BASIC = [*STATIC, *ENCODED, *TEMPORAL, *GEOGRAPHIC, *IDENTITY]
PRIOR = feature_names(ENTITIES, None)
ROLLING = feature_names(ENTITIES, WINDOWS_US, prior=False)
ENGINEERED = [*STATIC, *ENCODED, *TEMPORAL, *PRIOR, *GEOGRAPHIC, *IDENTITY]


def row_features(df: DataFrame, encoder: FrequencyEncoder, keep: Sequence[str] = ()) -> DataFrame:
    """The features that need no history; the same projection on a table or a stream."""
    encoded = encoder.transform(df)
    wanted = [f"{c}_encoded" for c in encoder.columns]
    absent = [F.lit(0.0).alias(c) for c in ENCODED if c not in wanted]
    return encoded.select(*keep, *feature_columns([*STATIC, *TEMPORAL, *GEOGRAPHIC, *IDENTITY]), *wanted, *absent)


def finish(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    assert_no_leakage(names)
    types = dict(df.dtypes)
    return df.select(*keep, *[sanitised(n, types[n]) for n in names])


def feature_table(
    df: DataFrame,
    encoder: FrequencyEncoder,
    include_velocity: bool = True,
    exact: bool = False,
    history: DataFrame | None = None,
    keep: Sequence[str] = (),
    strategy: str = "auto",
) -> DataFrame:
    """``transaction_id``, the ``keep`` columns and the features of ``df``.

    ``history`` (transactions before ``df``) feeds the history features only.
    """
    kept = ["transaction_id", *[k for k in keep if k != "transaction_id"]]
    if not include_velocity:
        return finish(row_features(df, encoder, kept), BASIC, kept)
    windows = WINDOWS_US if exact else None
    # An id alone does not tell rows apart.
    place = {"_id": F.col("transaction_id"), "_us": F.unix_micros("event_timestamp"), "_seq": F.coalesce(F.col("transaction_sequence_id"), F.lit(0)).cast("bigint")}
    rows = row_features(df.withColumns(place), encoder, [*kept, *place])
    past = velocity(df, ENTITIES, windows, history=history, strategy=strategy, keyed=True).withColumnRenamed("transaction_id", "id")
    same = F.col("_id").eqNullSafe(F.col("id")) & F.col("_us").eqNullSafe(F.col("us")) & F.col("_seq").eqNullSafe(F.col("seq"))
    names = [*ENGINEERED, *ROLLING] if exact else ENGINEERED
    return finish(rows.join(past, same, "left"), names, kept)
