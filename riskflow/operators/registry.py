"""REG1: the catalogue of features, read off the feature table itself.

Nothing is listed here: names and families come from the rules' own tables, types from the schema of the feature table, and a feature's
default is what the rules make of a transaction of which nothing is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.functions.scalar import GEOGRAPHIC, IDENTITY, STATIC, TEMPORAL
from riskflow.operators.encode import FrequencyEncoder
from riskflow.operators.velocity import feature_names
from riskflow.plans.features import ENCODED, ENGINEERED, PRIOR, ROLLING, feature_table
from riskflow.schema import CATEGORICAL, TXN

FAMILIES: dict[str, list[str]] = {
    "static": list(STATIC), "categorical": ENCODED, "temporal": list(TEMPORAL), "geographic": list(GEOGRAPHIC),
    "identity": list(IDENTITY), "history": PRIOR, "velocity": ROLLING,
}
_FAMILY_OF = {name: family for family, members in FAMILIES.items() for name in members}
_WINDOW_OF = {name: w for w, us in WINDOWS_US.items() for name in feature_names(ENTITIES, {w: us}, prior=False)}


def catalogue(spark: SparkSession) -> DataFrame:
    """``name, family, type, default_value, window, needs_history, in_default_set``, one row a feature, in the order of the table."""
    unknown = spark.createDataFrame([tuple(None for _ in TXN)], TXN, verifySchema=False)
    table = feature_table(unknown, FrequencyEncoder(list(CATEGORICAL), {c: {} for c in CATEGORICAL}), exact=True)
    types, row = dict(table.dtypes), table.first()
    return spark.createDataFrame(
        [
            (name, _FAMILY_OF[name], types[name], float(row[name]), _WINDOW_OF.get(name), _FAMILY_OF[name] in ("history", "velocity"), name in ENGINEERED)
            for name in types if name in _FAMILY_OF
        ],
        "name string, family string, type string, default_value double, window string, needs_history boolean, in_default_set boolean",
    )
