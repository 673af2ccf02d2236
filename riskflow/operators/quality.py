"""Quality checks of a transactions table (QLT1-9, QLT11, QLT13)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.config import DatasetExpectation
from riskflow.schema import COLUMNS, NUMERIC_COLUMNS, REQUEST_DEFAULTS, TYPE_OF


class QualityError(ValueError):
    def __init__(self, check: str, detail: str) -> None:
        self.check = check
        super().__init__(f"{check}: {detail}")


def _canonical(name: str, dtype: str) -> Column:
    """A value as text that no other value has: nulls are marked, lengths lead, so neighbours can't run together."""
    c = F.col(name)
    if dtype in ("double", "float"):
        c = c.cast("decimal(30,9)")
    elif dtype == "timestamp":
        c = F.unix_micros(c)
    text = c.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """QLT1: order-insensitive content fingerprint of all columns, one aggregate without a sort.

    The two halves of each row's digest are added up as decimals of 38 digits, which no table overflows.
    """
    types = dict(df.dtypes)
    digest = F.md5(F.concat(*[_canonical(c, types[c]) for c in columns or df.columns]))
    halves = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)")) for at in (1, 17)]
    total = F.concat_ws("-", *[F.coalesce(h, F.lit(0).cast("decimal(38,0)")).cast("string") for h in halves])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.alias("fingerprint"))


def column_problems(columns: Sequence[str], expected: Sequence[str] = COLUMNS) -> str:
    """QLT2: empty when names and order agree; runs no job."""
    missing = [c for c in expected if c not in columns]
    extra = [c for c in columns if c not in expected]
    if missing or extra:
        return f"missing {missing}, unexpected {extra}"
    return "" if list(columns) == list(expected) else "column order differs"


def non_numeric(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS) -> dict[str, Column]:
    """QLT3: aggregates counting values that are not numbers; nothing to scan for typed columns."""
    out: dict[str, Column] = {}
    for c in columns:
        if c not in df.columns:
            continue
        if isinstance(df.schema[c].dataType, T.NumericType):
            out[c] = F.lit(0).cast("bigint")
        else:
            out[c] = F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull())
    return out


def duplicates(df: DataFrame, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """QLT5: rows beyond the first of their key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"), F.count_if(F.col("c") > 1).alias("duplicated_keys")
    )


def null_census(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """QLT6: rows ``(column, nulls)`` from one pass."""
    names = list(columns or df.columns)
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).unpivot([], names, "column", "nulls")


def table_summary(df: DataFrame) -> DataFrame:
    """QLT4, 6, 7, 8, 9 as one row from one pass."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    outlier_fraud = F.when(F.col("is_outlier") == 1, F.col("true_fraud_label")).otherwise(0)

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        nulls.alias("n_nulls"),
        F.min("event_timestamp").alias("ts_min"),
        F.max("event_timestamp").alias("ts_max"),
        total(F.col("true_fraud_label")).alias("n_fraud"),
        total(F.col("observed_label")).alias("n_observed"),
        total(F.col("is_outlier")).alias("n_outlier"),
        total(outlier_fraud).alias("fraud_in_outliers"),
    )


def outlier_crosscheck(df: DataFrame) -> DataFrame:
    """QLT9: rows and fraud by outlier flag."""
    fraud = F.sum(F.col("true_fraud_label").cast("bigint"))
    return df.groupBy("is_outlier").agg(F.count(F.lit(1)).alias("n_rows"), fraud.alias("n_fraud"))


def fill_defaults(df: DataFrame, defaults: dict[str, object] = REQUEST_DEFAULTS) -> DataFrame:
    """QLT11: complete a sparse request; fields without a default are left as they are."""
    out = df
    for name, value in defaults.items():
        literal = F.lit(value).cast(TYPE_OF[name])
        out = out.withColumn(name, F.coalesce(F.col(name), literal) if name in df.columns else literal)
    return out


@dataclass(frozen=True)
class CheckRow:
    check: str
    status: str
    detail: str


def validate(df: DataFrame, expected: DatasetExpectation = DatasetExpectation(), fail_fast: bool = True, check_duplicate_rows: bool = False) -> DataFrame:
    """QLT13: rows ``(check, status, detail)`` with status passed, failed or warning.

    Two jobs whatever the number of checks: one pass of aggregates and one count per
    id. ``fail_fast`` raises on the first failure in report order.
    """
    rows: list[CheckRow] = []

    def report(check: str, problem: str) -> None:
        rows.append(CheckRow(check, "failed" if problem else "passed", problem))
        if problem and fail_fast:
            raise QualityError(check, problem)

    def warn(check: str, problem: str) -> None:
        rows.append(CheckRow(check, "warning" if problem else "passed", problem))

    spark = df.sparkSession
    names_problem = column_problems(df.columns)
    report("column_schema", names_problem)
    have = set(df.columns)
    aggregates: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    aggregates += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns]
    aggregates += [a.alias(f"text_{c}") for c, a in non_numeric(df).items()]
    if "event_timestamp" in have:
        aggregates += [
            F.min(F.col("event_timestamp").cast("timestamp")).alias("ts_min"),
            F.max(F.col("event_timestamp").cast("timestamp")).alias("ts_max"),
            (F.min(F.col("event_timestamp").cast("timestamp")) < F.lit(expected.timestamp_min).cast("timestamp") - F.expr("INTERVAL 1 DAY")).alias("too_early"),
            (F.max(F.col("event_timestamp").cast("timestamp")) > F.lit(expected.timestamp_max).cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("too_late"),
        ]
    flags = [c for c in ("true_fraud_label", "observed_label", "is_outlier") if c in have]
    aggregates += [F.sum(F.expr(f"try_cast(`{c}` AS BIGINT)")).alias(f"sum_{c}") for c in flags]
    if {"true_fraud_label", "is_outlier"} <= have:
        aggregates.append(F.sum(F.when(F.expr("try_cast(is_outlier AS BIGINT)") == 1, F.expr("try_cast(true_fraud_label AS BIGINT)"))).alias("fraud_in_outliers"))
    seen = df.agg(*aggregates).first().asDict()

    textual = [c for c in NUMERIC_COLUMNS if seen.get(f"text_{c}")]
    report("data_types", f"not numeric: {textual}" if textual else "")
    report("row_count", f"expected at least {expected.row_count}, got {seen['n_rows']}" if seen["n_rows"] < expected.row_count else "")
    if "transaction_id" in have:
        dup = duplicates(df).first()["duplicate_rows"]
        report("txn_id_unique", f"{dup} duplicate transaction ids" if dup else "")
    nulls = {c: seen[f"null_{c}"] for c in df.columns if seen[f"null_{c}"]}
    report("no_nulls", f"{sum(nulls.values())} nulls in {sorted(nulls)}" if nulls else "")
    if "event_timestamp" in have:
        report("timestamp_readable", "no readable timestamp" if seen["ts_min"] is None and seen["n_rows"] else "")
        early = f"first {seen['ts_min']} is before {expected.timestamp_min}" if seen["too_early"] else ""
        late = f"last {seen['ts_max']} is after {expected.timestamp_max}" if seen["too_late"] else ""
        report("timestamp_range", early or late)
    for check, flag, want in (
        ("target_distribution", "true_fraud_label", expected.fraud_count),
        ("observed_distribution", "observed_label", expected.observed_count),
        ("outlier_distribution", "is_outlier", expected.outlier_count),
    ):
        if flag in have:
            got = seen[f"sum_{flag}"] or 0
            warn(check, f"{got} differs from expected {want}" if want is not None and got != want else "")
    if "fraud_in_outliers" in seen:
        n = seen["fraud_in_outliers"] or 0
        warn("outlier_fraud_separation", f"{n} fraud rows are flagged as outliers" if n else "")
    if check_duplicate_rows:
        same = duplicates(df, df.columns).first()["duplicate_rows"]
        report("no_duplicate_rows", f"{same} repeated rows" if same else "")
    if expected.fingerprint is not None:
        found = fingerprint(df, df.columns).first()["fingerprint"]
        report("fingerprint", f"expected {expected.fingerprint}, got {found}" if found != expected.fingerprint else "")
    return spark.createDataFrame([(r.check, r.status, r.detail) for r in rows], "check string, status string, detail string")
