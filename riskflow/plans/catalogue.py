"""The registered queries: every operator over the whole supplied tables."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.config import CURVE_THRESHOLDS, ENTITIES, JANUARY_2024, WINDOWS_US, DatasetExpectation, SplitBounds
from riskflow.functions.report import rounded
from riskflow.functions.scalar import GEOGRAPHIC, IDENTITY, TEMPORAL, feature_columns
from riskflow.operators import (
    bootstrap,
    calibration,
    decisions,
    drift,
    encode,
    entity_state,
    explain,
    gates,
    leakage,
    metrics,
    monitoring,
    quality,
    splits,
    thresholds,
    training,
    velocity,
)
from riskflow.plans.experiment import TrainingPlan, labelled, split_features
from riskflow.plans.features import BASIC, ENGINEERED, feature_table
from riskflow.plans.scoring import Scorer
from riskflow.schema import FORBIDDEN, ONLINE_COLUMNS
from riskflow.session import STATE_STORE, checkpoint_dir, freeze
from riskflow.sources.files import read_csv, read_parquet, write_table
from riskflow.sources.fixture import TRANSACTIONS_SQL, scored, table, transactions
from riskflow.sources.kafka import messages, route
from riskflow.sources.sinks import label_free_feed
from riskflow.streaming.ingest import dead_letters, validate_messages
from riskflow.streaming.state import stream_history

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

APPROVE_BELOW, BLOCK_FROM = 0.35, 0.8
GRID_STEPS = 30
DRIFT_FEATURES = ["amount", "credit_limit", "customer_tenure_days", "device_age_days", "merchant_age_days"]
GAP_US = 3_600_000_000
DAY_US = 86_400_000_000
#: Features compared between the table and the messages.
PARITY = [*TEMPORAL, *GEOGRAPHIC, *IDENTITY, "log_amount", "amount_credit_ratio", "amount_bucket"]
#: Training ends after validation begins, calibration after optimisation begins; the 24th is in no split.
OVERLAPPING = SplitBounds("2024-01-21 23:59:59", "2024-01-21 00:00:00", "2024-01-23 23:59:59", "2024-01-22 12:00:00", "2024-01-23 23:59:59", "2024-01-25 00:00:00")
#: Amounts that write the value ``last_large``.
LARGE = 50.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_split(transactions(spark, sf_dir), JANUARY_2024)


# ── flagship ──────────────────────────────────────────────────────────────────


@query
def scored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the customer's past, scored and decided; totals per decision."""
    txns = transactions(spark, sf_dir)
    past = velocity.velocity(txns, {"customer": "customer_id"}, windows=None)
    rows = (
        scored(spark, sf_dir)
        .select("transaction_id", "event_timestamp", "p")
        .join(past, "transaction_id")
        .select("*", *feature_columns(["hour_of_day", "day_of_week", "is_night"]))
    )
    return (
        decisions.decide(rows)
        .groupBy("decision", "risk_level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("is_night").cast("bigint").alias("n_night"),
            F.sum("customer_total_txn_count").cast("bigint").alias("sum_prior"),
            rounded(F.avg("time_since_prev_customer_txn_seconds"), 2).alias("avg_gap_s"),
            F.max("risk_score").alias("max_score"),
        )
    )


# ── scalar features ───────────────────────────────────────────────────────────


@query
def feat_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["log_amount", "amount_credit_ratio", "is_international", "is_installment", "amount_bucket", "is_micro_txn", "is_high_value_txn"]
    return _rounded(transactions(spark, sf_dir).select("transaction_id", *feature_columns(names)), 4, "log_amount", "amount_credit_ratio")


@query
def feat_age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["customer_tenure_bucket", "card_age_bucket", "device_age_bucket"]
    return transactions(spark, sf_dir).select("transaction_id", *feature_columns(names))


@query
def feat_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("transaction_id", *feature_columns(list(TEMPORAL)))


@query
def feat_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("transaction_id", *feature_columns(list(GEOGRAPHIC)))


@query
def feat_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select("transaction_id", *feature_columns(list(IDENTITY)))


# ── quality, leakage, splits ──────────────────────────────────────────────────


@query
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = quality.table_summary(transactions(spark, sf_dir))
    return summary.withColumns({c: F.unix_micros(c) for c in ("ts_min", "ts_max")})


@query
def quality_null_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names blanked by rule, so that the census has something to find."""
    txns = transactions(spark, sf_dir)
    holes = {"proxy_type": "none", "connection_type": "mobile", "customer_country": "UK"}
    blanked = txns.withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, v in holes.items()})
    return quality.null_census(blanked, [*holes, "amount", "currency"])


@query
def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def quality_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fingerprint(transactions(spark, sf_dir))


@query
def csv_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: the table sent through CSV text; the fingerprint of what is read back."""
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    transactions(spark, sf_dir).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    return quality.fingerprint(read_csv(spark, path))


@query
def dated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the table in its canonical layout, read back by day from the training period on."""
    path = f"{checkpoint_dir(spark)}/dated-{uuid.uuid4().hex}"
    write_table(transactions(spark, sf_dir), path)
    days = read_parquet(spark, path, ["event_date", "transaction_id", "amount", "is_outlier"]).where("event_date > DATE '2024-01-20'")
    return days.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_outlier").alias("n_outlier"), rounded(F.sum("amount"), 2).alias("amount"),
        F.min("transaction_id").alias("first_id"), F.max("transaction_id").alias("last_id"))


@query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = DatasetExpectation(timestamp_min="2024-01-01", timestamp_max="2024-01-31")
    return quality.validate(transactions(spark, sf_dir), expected, fail_fast=False).select("check", "status")


@query
def outlier_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.outlier_crosscheck(transactions(spark, sf_dir))


def _raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages with defects injected by rule of the sequence number."""
    good = messages(leakage.strip_labels(transactions(spark, sf_dir)).withColumn("_n", F.col("transaction_sequence_id")), drop=["_n"])
    n = F.regexp_extract("key", r"(\d+)$", 1).cast("bigint")
    text = F.col("value")
    broken = (
        F.when(n % 20 == 1, F.concat(F.lit("{"), text))
        .when(n % 20 == 2, F.regexp_replace(text, r"\}$", ',"surprise":1}'))
        .when(n % 20 == 3, F.regexp_replace(text, r"\}$", ',"true_fraud_label":1}'))
        .when(n % 20 == 4, F.regexp_replace(text, r'"currency":"[A-Z]+",', ""))
        .when(n % 20 == 5, F.regexp_replace(text, r'"installment_flag":\d', '"installment_flag":"many"'))
        .otherwise(text)
    )
    return good.select("key", broken.alias("value"))


@query
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = validate_messages(_raw_messages(spark, sf_dir))
    return validated.groupBy(F.coalesce("error", F.lit("valid")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(F.when(F.col("error").isNull(), F.col("amount"))), 2).alias("amount")
    )


@query
def dead_letter_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = dead_letters(validate_messages(_raw_messages(spark, sf_dir)))
    return letters.select("key", "topic", F.get_json_object("value", "$.error").alias("error"), F.get_json_object("value", "$.original_topic").alias("origin"))


@query
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse requests completed with defaults; totals of what was filled in."""
    sparse = transactions(spark, sf_dir).select(
        "transaction_id", "event_timestamp", "customer_id", "account_id", "card_id", "merchant_id", "device_id", "ip_id", "amount",
        F.when(F.col("transaction_sequence_id") % 3 == 0, F.col("currency")).alias("currency"),
        F.when(F.col("transaction_sequence_id") % 4 == 0, F.col("credit_limit")).alias("credit_limit"),
    )
    full = quality.fill_defaults(sparse).select(*ONLINE_COLUMNS)
    return full.groupBy("currency", "device_os", "proxy_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("credit_limit").alias("sum_limit"), F.sum("merchant_age_days").alias("sum_age")
    )


@query
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(splits.split_distribution(_split(spark, sf_dir)), 4, "fraud_pct")


@query
def split_overlaps_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPL3 on bounds that do overlap, and leave out a day."""
    return splits.split_overlaps(transactions(spark, sf_dir), OVERLAPPING)


@query
def aligned_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPL7-8: two tables' common columns, with holes and values that are no numbers, in the first one's rows."""
    seq = F.col("transaction_sequence_id")
    amount = F.when(seq % 7 == 0, F.lit(float("nan"))).when(seq % 11 == 0, F.lit(float("-inf"))).otherwise(F.col("amount"))
    txns = transactions(spark, sf_dir)
    first = txns.select("transaction_id", "device_age_days", amount.alias("amount"), F.nullif("credit_limit", F.lit(1000.0)).alias("credit_limit"), "currency")
    second = txns.select("credit_limit", "merchant_age_days", "amount", "device_age_days")
    names = [*splits.common_columns(first, second), "merchant_age_days"]
    return splits.align_to(first, names, keep=["transaction_id"])


@query
def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_overlaps(transactions(spark, sf_dir), JANUARY_2024)


@query
def future_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features at or before a cut, computed with and without the rows after it."""
    txns = transactions(spark, sf_dir)
    past = txns.where(F.col("event_timestamp") <= F.lit(JANUARY_2024.train_end).cast("timestamp"))
    with_future = velocity.velocity(txns, {"customer": "customer_id", "merchant": "merchant_id"}, windows=None)
    without = velocity.velocity(past, {"customer": "customer_id", "merchant": "merchant_id"}, windows=None)
    changed = leakage.future_changes_past(with_future, without).agg(F.count(F.lit(1)).alias("n_changed"), F.lit(1).alias("_one"))
    return without.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(1).alias("_one")).join(changed, "_one").select("n_rows", "n_changed")


@query
def future_leak_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LKG6 on features that do look ahead: totals of an entity's whole history; the rows it names, for each of the six entities."""
    txns = transactions(spark, sf_dir)
    past = txns.where(F.col("event_timestamp") <= F.lit(JANUARY_2024.train_end).cast("timestamp"))

    def ahead(rows: DataFrame, column: str) -> DataFrame:
        totals = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_ever"), F.max("amount").alias("max_ever"))
        return rows.select("transaction_id", column).join(totals, column)

    found = [
        leakage.future_changes_past(ahead(txns, column), ahead(past, column)).agg(F.lit(entity).alias("entity"), F.count(F.lit(1)).alias("n_changed"))
        for entity, column in ENTITIES.items()
    ]
    return reduce(DataFrame.unionByName, found)


# ── encoding ──────────────────────────────────────────────────────────────────


@query
def freq_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _split(spark, sf_dir).where("split = 'TRAIN'")
    return _rounded(encode.frequency_table(train).select("col", "val", "n", "freq"), 6, "freq")


@query
def freq_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    encoder = encode.FrequencyEncoder.fit(rows.where("split = 'TRAIN'"))
    names = [f"{c}_encoded" for c in encoder.columns]
    return _rounded(encoder.transform(rows).select("transaction_id", *names), 6, *names)


@query
def freq_encoded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with many values, encoded by a join instead of maps."""
    rows = _split(spark, sf_dir)
    encoder = encode.FrequencyEncoder.fit(rows.where("split = 'TRAIN'"), ["customer_id", "currency"], map_limit=10)
    names = [f"{c}_encoded" for c in encoder.columns]
    return _rounded(encoder.transform(rows).select("transaction_id", *names), 6, *names)


@query
def own_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENC3: every row encoded with the frequencies of all rows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the warning is the operator's point, and expected here
        encoded = encode.encode_with_own_frequencies(transactions(spark, sf_dir))
    names = [c for c in encoded.columns if c.endswith("_encoded")]
    return _rounded(encoded.select("transaction_id", *names), 6, *names)


# ── velocity ──────────────────────────────────────────────────────────────────


def _rolling(df: DataFrame, entities: dict[str, str], **options) -> DataFrame:
    out = velocity.velocity(df, entities, WINDOWS_US, prior=False, **options)
    return _rounded(out, 3, *[c for c in out.columns if "_amount_sum_" in c])


def _prior(df: DataFrame, entities: dict[str, str], **options) -> DataFrame:
    out = velocity.velocity(df, entities, None, **options)
    return _rounded(out, 3, *[c for c in out.columns if c.endswith(("_avg_amount", "_std_amount", "_seconds")) or c.startswith("amount_zscore_")])


@query
def velocity_windows_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(transactions(spark, sf_dir), {"customer": "customer_id"})


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).withColumn("event_timestamp", F.date_trunc("hour", "event_timestamp"))


@query
def velocity_windows_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to the hour, so that rows of one instant must be told apart by order."""
    return _rolling(_hourly(spark, sf_dir), {"merchant": "merchant_id"})


@query
def velocity_windows_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result by running totals, the way for keys of any size."""
    return _rolling(_hourly(spark, sf_dir), {"merchant": "merchant_id"}, strategy="totals")


LINEITEM_SQL = """
SELECT lpad(CAST(l_orderkey AS STRING),10,'0') || '-' || CAST(l_linenumber AS STRING) || '-' || lpad(CAST(l_partkey AS STRING),9,'0')
         || '-' || lpad(CAST(l_suppkey AS STRING),9,'0') || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING) AS transaction_id,
       CAST(l_shipdate AS TIMESTAMP) AS event_timestamp, l_orderkey*8 + l_linenumber AS transaction_sequence_id,
       l_suppkey AS supplier_id, l_extendedprice AS amount
FROM {lineitem}
"""


@query
def velocity_lineitem_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(LINEITEM_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    out = velocity.velocity(rows, {"supplier": "supplier_id"}, {"7d": WINDOWS_US["7d"], "30d": 30 * WINDOWS_US["24h"]}, prior=False)
    return _rounded(out, 3, "supplier_amount_sum_7d", "supplier_amount_sum_30d")


@query
def velocity_cumulative_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prior(transactions(spark, sf_dir), {"customer": "customer_id"})


@query
def velocity_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third transaction names no customer; none is lost."""
    holes = F.when(F.col("transaction_sequence_id") % 3 != 0, F.col("customer_id"))
    return _prior(transactions(spark, sf_dir).withColumn("customer_id", holes), {"customer": "customer_id"})


@query
def velocity_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that many transactions share; each keeps its own row."""
    shared = F.concat(F.lit("T"), (F.col("transaction_sequence_id") % 100).cast("string"))
    return _prior(transactions(spark, sf_dir).withColumn("transaction_id", shared), {"customer": "customer_id"})


@query
def velocity_cumulative_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prior(transactions(spark, sf_dir), {"customer": "customer_id"}, strategy="totals")


@query
def velocity_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prior(transactions(spark, sf_dir), dict(ENTITIES))


@query
def velocity_windows_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolling(transactions(spark, sf_dir), dict(ENTITIES))


@query
def velocity_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    return _prior(rows.where("split = 'TEST'"), {"customer": "customer_id", "card": "card_id"}, history=rows.where("split <> 'TEST'"))


@query
def feature_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 79-column feature table of all transactions, summed per feature."""
    rows = _split(spark, sf_dir)
    encoder = encode.FrequencyEncoder.fit(rows.where("split = 'TRAIN'"))
    table_ = feature_table(rows, encoder)
    sums = table_.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ENGINEERED])
    return _rounded(sums.unpivot([], ENGINEERED, "feature", "total"), 1, "total")


# ── entity state ──────────────────────────────────────────────────────────────


@query
def session_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = velocity.entity_rows(transactions(spark, sf_dir))
    return _rounded(entity_state.gap_counters(rows, GAP_US), 3, "amount_sum")


def _updates(df: DataFrame) -> DataFrame:
    return entity_state.transaction_updates(
        df, {"last_country": F.col("transaction_country"), "last_txn_id": F.col("transaction_id"), "last_channel": F.col("payment_channel")}
    )


@query
def entity_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_state.latest_values(_updates(transactions(spark, sf_dir)))


@query
def entity_live_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that expire a day after their last update, as of the newest transaction; the large one is written by some transactions only."""
    rows = transactions(spark, sf_dir)
    updates = entity_state.transaction_updates(rows, {"last_country": F.coalesce("transaction_country", F.lit("")), "last_large": F.when(F.col("amount") >= LARGE, F.col("transaction_id"))})
    newest = rows.agg(F.max(F.unix_micros("event_timestamp"))).first()[0]
    return entity_state.latest_values(updates.where("value IS NOT NULL"), ttl_us=DAY_US, as_of_us=newest)


@query
def entity_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = entity_state.feature_maps(entity_state.latest_values(_updates(transactions(spark, sf_dir))))
    pairs = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("entity", "entity_id", F.array_join(pairs, ";").alias("features"))


@query
def entity_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = entity_state.snapshot(transactions(spark, sf_dir))
    return _rounded(state, 3, "amount_sum", "mean_amount").withColumn("m2_amount", rounded("m2_amount", 1))


@query
def txn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir)
    state = entity_state.snapshot(rows.where("split <> 'TEST'"))
    return entity_state.transaction_context(rows.where("split = 'TEST'"), state, ["txn_count", "last_us"])


# ── metrics ───────────────────────────────────────────────────────────────────


@query
def confusion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(scored(spark, sf_dir), 0.5)
    return _rounded(out.select("threshold", "n", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "specificity", "false_positive_rate"), 6,
                    "precision", "recall", "f1", "specificity", "false_positive_rate")


@query
def roc_pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ranking(scored(spark, sf_dir)), 6, "roc_auc", "pr_auc", "prevalence", "pr_auc_lift")


@query
def roc_pr_auc_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("day", F.date_format("event_timestamp", "yyyy-MM-dd"))
    return _rounded(metrics.ranking(rows, ["day"]), 6, "roc_auc", "pr_auc", "prevalence", "pr_auc_lift")


@query
def brier_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(calibration.score_quality(scored(spark, sf_dir), ["p"]), 6, "brier", "ece")


@query
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.precision_at_k(scored(spark, sf_dir)), 6, "precision_at_k", "recall_at_k")


@query
def cost_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = ["fraud_loss_prevented", "fraud_loss_missed", "false_positive_cost", "total_expected_cost", "net_benefit"]
    by_amount = metrics.confusion(scored(spark, sf_dir), 0.5).select(F.lit("amount").alias("basis"), *money)
    by_count = metrics.confusion(scored(spark, sf_dir), 0.5, from_amounts=False).select(F.lit("count").alias("basis"), *money)
    return _rounded(by_amount.unionByName(by_count), 2, *money)


@query
def context_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5: for every transaction and entity the newest payment of more than 200 up to its time: amount and time, null before the first."""
    rows = leakage.strip_labels(transactions(spark, sf_dir))
    versions = velocity.entity_rows(rows.where("amount > 200")).groupBy("entity", "entity_id", "us").agg(
        F.max("seq").alias("seq"), F.max("amount").alias("large_amount"), F.max("us").alias("large_us"))
    return entity_state.context_as_of(rows, versions, ["large_amount", "large_us"]).drop("us", "seq")


@query
def fraud_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.fraud_metrics(scored(spark, sf_dir), 0.4)
    names = ["roc_auc", "pr_auc", "pr_auc_lift", "precision", "recall", "f1", "brier", "precision_at_100", "precision_at_500", "recall_at_100", "recall_at_500"]
    return _rounded(out.select("threshold", "tp", "fp", "tn", "fn", *names, rounded("net_benefit", 2).alias("net_benefit")), 6, *names)


@query
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.threshold_curve(scored(spark, sf_dir), CURVE_THRESHOLDS)
    return _rounded(out.select("threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", rounded("net_benefit", 2).alias("net_benefit")), 6, "precision", "recall", "f1")


@query
def cost_at_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thresholds.cost_at(scored(spark, sf_dir), APPROVE_BELOW, BLOCK_FROM)
    return _rounded(out, 2, "fraud_loss_prevented", "fraud_loss_missed", "false_positive_cost", "review_cost", "total_cost", "net_benefit")


@query
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = thresholds.cost_grid(scored(spark, sf_dir), GRID_STEPS)
    out = grid.select("approve_threshold", "block_threshold", "fraud_caught", "fraud_missed", "false_declines", "manual_reviews", "net_benefit")
    return _rounded(_rounded(out, 2, "net_benefit"), 6, "approve_threshold", "block_threshold")


@query
def threshold_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = thresholds.best_thresholds(scored(spark, sf_dir), GRID_STEPS)
    out = best.select("approve_threshold", "block_threshold", "fraud_caught", "fraud_missed", "false_declines", "manual_reviews", "net_benefit")
    return _rounded(_rounded(out, 2, "net_benefit"), 6, "approve_threshold", "block_threshold")


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap.bootstrap_ci(scored(spark, sf_dir), 0.4, n_boot=500)


# ── drift ─────────────────────────────────────────────────────────────────────


def _populations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _split(spark, sf_dir)
    return rows.where("split = 'TRAIN'"), rows.where("split = 'TEST'")


@query
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.psi(drift.stored_values(*_populations(spark, sf_dir), DRIFT_FEATURES)), 6, "psi")


@query
def drift_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.js_distance(drift.feature_values(*_populations(spark, sf_dir), DRIFT_FEATURES), 50), 6, "js")


@query
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = drift.value_counts(*_populations(spark, sf_dir), DRIFT_FEATURES)
    return _rounded(drift.ks_statistic(drift.ordered_counts(counts)), 6, "ks")


@query
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.check_drift(*_populations(spark, sf_dir), DRIFT_FEATURES, ("ks", "js"))
    return _rounded(found, 6, "value")


@query
def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.drift_summary(drift.check_drift(*_populations(spark, sf_dir), DRIFT_FEATURES, ("ks", "js")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("critical_features", "warning_features")})


@query
def drift_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(drift.population_drift(*_populations(spark, sf_dir), DRIFT_FEATURES), 6, "psi", "js_distance")


@query
def drift_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MON4: the values of a drift check as rows stamped with the time of the run."""
    found = drift.check_drift(*_populations(spark, sf_dir), DRIFT_FEATURES, ("psi", "js"))
    gauges = monitoring.drift_gauge(found, F.lit("2024-02-01 06:30:00").cast("timestamp"))
    return _rounded(gauges, 6, "value").withColumn("run_at", F.unix_micros("run_at"))


# ── scoring, gates, monitoring ────────────────────────────────────────────────


@query
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(scored(spark, sf_dir).select("transaction_id", "p"))
    return decided.select("transaction_id", "risk_score", "risk_level", "decision")


@query
def decisions_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(scored(spark, sf_dir), approve_below=APPROVE_BELOW, block_from=BLOCK_FROM)
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_fraud"))


@query
def failed_rows_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose scoring failed go to review, never to approval."""
    broken = F.when(F.substring("transaction_id", -1, 1) == "7", F.lit("scoring failed"))
    decided = decisions.decide(scored(spark, sf_dir).withColumn("error", broken), error="error")
    return decided.groupBy("decision", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_failed"), F.max("risk_score").alias("max_score"))


@query
def output_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(scored(spark, sf_dir))
    return decisions.out_of_bounds(decided).agg(F.count(F.lit(1)).alias("violations"))


@query
def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.promotion_gates(metrics.fraud_metrics(scored(spark, sf_dir), 0.4))
    return _rounded(found, 4, "value")


@query
def promotion_gates_from_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT1 with its last gates answered by results: a squared score against the raw one, a drift check, the features' names."""
    rows = scored(spark, sf_dir)
    briers = rows.agg(*[F.avg((F.col("y") - x) ** 2).alias(m) for m, x in (("raw", F.col("p")), ("squared", F.col("p") ** 2))]).unpivot([], ["raw", "squared"], "method", "brier")
    evidence = gates.promotion_evidence(briers, drift.check_drift(*_populations(spark, sf_dir), DRIFT_FEATURES, ("psi", "js")), [*ENGINEERED, "fraud_scenario"])
    return _rounded(gates.promotion_gates(metrics.fraud_metrics(rows, 0.4), **evidence), 4, "value")


@query
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.promotion_decision(gates.promotion_gates(metrics.fraud_metrics(scored(spark, sf_dir), 0.4)))


@query
def retrain_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten days against the twenty before them."""
    rows = scored(spark, sf_dir)
    recent = F.col("event_timestamp") > F.lit(JANUARY_2024.train_end).cast("timestamp")
    current, base = metrics.fraud_metrics(rows.where(recent), 0.4), metrics.fraud_metrics(rows.where(~recent), 0.4)
    return _rounded(gates.retrain_trigger(current, base, drift_detected=True), 6, "pr_auc_drop", "recall_drop")


@query
def decision_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = monitoring.decision_counts(decisions.decide(scored(spark, sf_dir)))
    out = monitoring.decision_ratios(counts).withColumn("window_start", F.unix_micros("window_start"))
    return _rounded(out, 6, "approve_ratio", "review_ratio", "block_ratio")


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(scored(spark, sf_dir))
    named = [("probability", "fraud_probability", monitoring.PROBABILITY_BOUNDS), ("score", "risk_score", monitoring.SCORE_BOUNDS)]
    parts = [monitoring.cumulative_histogram(decided, c, b).select(F.lit(n).alias("kind"), "upper_bound", "n") for n, c, b in named]
    # The unbounded bucket is reported as -1: JSON and CSV sinks have no infinity.
    return parts[0].unionByName(parts[1]).withColumn("upper_bound", F.when(F.col("upper_bound") == float("inf"), -1.0).otherwise(F.col("upper_bound")))


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.value`` stands in for a latency."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("event_timestamp"), F.col("value").alias("latency_ms"))
    out = monitoring.latency_percentiles(rows).withColumn("window_start", F.unix_micros("window_start"))
    return _rounded(out, 4, "p50", "p95", "p99")


@query
def label_free_feed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = label_free_feed(transactions(spark, sf_dir))
    keys = F.json_object_keys("value")
    field = {n: F.get_json_object("value", f"$.{n}") for n in ("event_timestamp", "customer_id", "currency")}
    return feed.select("key", "topic", F.size(keys).alias("n_fields"), F.arrays_overlap(keys, F.array(*[F.lit(c) for c in FORBIDDEN])).alias("leaks"),
                       *[c.alias(n) for n, c in field.items()])


@query
def topic_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route(decisions.decide(scored(spark, sf_dir).select("transaction_id", "p")))
    return routed.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def _beside(table_side: DataFrame, message_side: DataFrame) -> DataFrame:
    # Sizes guessed from the table's file say nothing about messages and features: left to them, one side was sent whole.
    return table_side.alias("a").join(message_side.alias("b").hint("merge"), "transaction_id")


@query
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REG2: features from typed rows against features from the same rows sent as messages."""
    txns = leakage.strip_labels(transactions(spark, sf_dir))
    names = PARITY
    table_side = txns.select("transaction_id", *feature_columns(names))
    sent = validate_messages(messages(txns)).where("error IS NULL")
    message_side = sent.select("transaction_id", *feature_columns(names))
    joined = _beside(table_side, message_side)
    differs = [F.count_if(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))).alias(n) for n in names]
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), *differs).unpivot(["n_rows"], names, "feature", "mismatches")


@query
def parity_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REG2 on messages that differ from the table: doubled amounts, times five hours on, another country of the address."""
    txns = leakage.strip_labels(transactions(spark, sf_dir))
    seq = F.col("transaction_sequence_id")
    changed = txns.withColumns({
        "amount": F.when(seq % 7 == 0, F.col("amount") * 2).otherwise(F.col("amount")),
        "event_timestamp": F.when(seq % 11 == 0, F.col("event_timestamp") + F.expr("INTERVAL 5 HOURS")).otherwise(F.col("event_timestamp")),
        "ip_country": F.when(seq % 13 == 0, "US").otherwise(F.col("ip_country")),
    })
    names = PARITY
    table_side = txns.select("transaction_id", *feature_columns(names))
    message_side = validate_messages(messages(changed)).where("error IS NULL").select("transaction_id", *feature_columns(names))
    joined = _beside(table_side, message_side)
    differs = [F.count_if(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))).alias(n) for n in names]
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), *differs).unpivot(["n_rows"], names, "feature", "mismatches")


# ── models (no SQL equivalent) ────────────────────────────────────────────────


def _boosted(train: DataFrame, val: DataFrame) -> training.FittedModel:
    return training.fit_boosted(train, val, ENGINEERED, name="boosted_engineered", **TrainingPlan().boosted_engineered)


def _features(spark: SparkSession, sf_dir: str):
    features, encoder = split_features(transactions(spark, sf_dir), JANUARY_2024)
    return features, encoder, *(features.where(F.col("split") == s) for s in ("TRAIN", "VAL", "TEST"))


@query
def logreg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, train, val, test = _features(spark, sf_dir)
    return labelled(training.fit_logistic(train, BASIC), val.unionByName(test))


@query
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, train, val, test = _features(spark, sf_dir)
    return labelled(_boosted(train, val), val.unionByName(test))


@query
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, train, val, test = _features(spark, sf_dir)
    return labelled(training.fit_forest(train, ENGINEERED, **TrainingPlan().forest), val.unionByName(test))


@query
def calibration_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations of the stand-in score, fitted on one sub-split and judged on the next."""
    rows = splits.assign_split(scored(spark, sf_dir), JANUARY_2024)
    fitted = calibration.Calibrator.fit(rows.where("subsplit = 'VAL_CALIB'"))
    return fitted.evaluate(rows.where("subsplit = 'VAL_OPT'"))


@query
def global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, train, val, _ = _features(spark, sf_dir)
    return explain.global_importance(training.fit_logistic(train, BASIC), val)


@query
def top_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, train, val, _ = _features(spark, sf_dir)
    return explain.top_contributors(training.fit_logistic(train, BASIC), val)


@query
def tree_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP2 on boosted trees: explanations, and the margin as the sum of the root values and all contributions."""
    _, _, train, val, test = _features(spark, sf_dir)
    fitted = _boosted(train, val)
    rows = explain.attributed(fitted, explain.with_explanations(fitted, val.unionByName(test).select("transaction_id", *ENGINEERED)))
    margin = F.aggregate("_c", F.lit(explain.node_table(fitted).base), lambda a, v: a + v)
    scored = fitted.score(rows.select("transaction_id", *ENGINEERED, "explanations", F.round(1 / (1 + F.exp(-2 * margin)), 9).alias("p_from_parts")))
    return scored.select("transaction_id", "explanations", "p_from_parts", F.round("p", 9).alias("p"))


@query
def permuted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP1 by permutation, of the linear model over all labelled rows after the training period."""
    _, _, train, val, test = _features(spark, sf_dir)
    return explain.permutation_importance(training.fit_logistic(train, BASIC), val.unionByName(test).select("true_fraud_label", *BASIC), "true_fraud_label")


@query
def scoring_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEC8: the test split scored with its history warmed up, with explanations."""
    _, encoder, train, _, _ = _features(spark, sf_dir)
    model = training.fit_logistic(train, ENGINEERED, name="logistic_engineered")
    rows = splits.assign_split(transactions(spark, sf_dir), JANUARY_2024)
    history = leakage.strip_labels(rows.where("split <> 'TEST'")).drop("split", "subsplit")
    current = leakage.strip_labels(rows.where("split = 'TEST'")).drop("split", "subsplit")
    return Scorer(model, encoder).score(current, history, explain=True)


@query
def saved_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRN8: the test split scored by a scorer and by the same one saved and loaded: rows, and rows that differ."""
    _, encoder, train, val, _ = _features(spark, sf_dir)
    model = training.fit_logistic(train, BASIC)
    calibrator = calibration.Calibrator.fit(labelled(model, val))
    calibrator.active = "isotonic"
    scorer = Scorer(model, encoder, calibrator, approve_below=APPROVE_BELOW, block_from=BLOCK_FROM)
    folder = f"{checkpoint_dir(spark)}/scorer-{uuid.uuid4().hex}"
    scorer.save(folder)
    rows = splits.assign_split(transactions(spark, sf_dir), JANUARY_2024).where("split = 'TEST'")
    current = leakage.strip_labels(rows).drop("split", "subsplit")
    in_memory, loaded = freeze(scorer.score(current)), freeze(Scorer.load(spark, folder).score(current))
    differing = in_memory.exceptAll(loaded).unionByName(loaded.exceptAll(in_memory))
    return loaded.agg(F.count(F.lit(1)).alias("scored")).withColumn("one", F.lit(1)).join(
        differing.agg(F.count(F.lit(1)).alias("differing")).withColumn("one", F.lit(1)), "one").select("scored", "differing")


@query
def stream_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming processor over the events table, read back from its sink."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    history = stream_history(spark.sql(TRANSACTIONS_SQL, events=source))
    spark.conf.set(provider, STATE_STORE)
    try:
        run = (
            history.writeStream.format("parquet")
            .option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    rows = spark.read.parquet(f"{out}/rows")
    return _rounded(
        rows.select("transaction_id", "entity", "entity_id", "n_prior", "avg_prior", "std_prior", "n_1h", "n_24h", "n_7d", "sum_7d"), 3,
        "avg_prior", "std_prior", "sum_7d",
    )


