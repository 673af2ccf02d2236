"""Operational tables (MON1-5); the same aggregates serve batch and stream."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskflow.functions.buckets import bucket
from riskflow.functions.quantiles import exact_quantiles

# Histogram upper bounds.
PROBABILITY_BOUNDS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99]
SCORE_BOUNDS = [100, 200, 300, 400, 500, 600, 700, 800, 900, 1000]


def decision_counts(df: DataFrame, ts: str = "event_timestamp", width: str = "1 hour") -> DataFrame:
    """MON1: decisions per window; works on a stream with a watermark on ``ts``."""
    return df.groupBy(F.window(ts, width).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "decision", "n"
    )


def decision_ratios(counts: DataFrame) -> DataFrame:
    """MON1: processed total, alerts (blocked) and shares per window."""

    def n_of(decision: str) -> Column:
        return F.sum(F.when(F.col("decision") == decision, F.col("n")).otherwise(0))

    total = F.sum("n")
    return counts.groupBy("window_start").agg(
        total.alias("processed"),
        n_of("BLOCK").alias("alerts"),
        (n_of("APPROVE") / total).alias("approve_ratio"),
        (n_of("REVIEW") / total).alias("review_ratio"),
        (n_of("BLOCK") / total).alias("block_ratio"),
    )


def cumulative_histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """MON2: rows ``(upper_bound, n)``: values at or below each bound; the last row has no bound."""
    col = F.col(value)
    bins = df.where(col.isNotNull()).groupBy(bucket(col, bounds, right_closed=True).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    marks = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(float(b)).alias("b")) for i, b in enumerate(bounds)],
        F.struct(F.lit(len(bounds)).alias("i"), F.lit(float("inf")).alias("b")),
    )
    return (
        bins.withColumn("m", F.explode(marks))
        .groupBy(F.col("m.b").alias("upper_bound"))
        .agg(F.sum(F.when(F.col("bin") <= F.col("m.i"), F.col("c")).otherwise(0)).alias("n"))
    )


def latency_percentiles(df: DataFrame, latency: str = "latency_ms", ts: str | None = "event_timestamp", width: str = "1 hour", qs: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """MON3: exact percentiles per window (or over all rows), one column per percentile."""
    keys = ["window_start"] if ts else []
    rows = df.select(F.col(latency).alias("latency"), *([F.window(ts, width)["start"].alias("window_start")] if ts else []))
    long = exact_quantiles(rows, keys, "latency", qs)
    names = {q: f"p{q * 100:g}".replace(".", "_") for q in qs}
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in names.items()])


def latency_sketch(df: DataFrame, latency: str = "latency_ms", ts: str = "event_timestamp", width: str = "1 hour") -> DataFrame:
    """MON3 for streams: mergeable approximate percentiles."""
    p = F.percentile_approx(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10_000)
    return df.groupBy(F.window(ts, width).alias("w")).agg(p.alias("q"), F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "n", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99")
    )


def drift_gauge(results: DataFrame, run_at: Column | None = None) -> DataFrame:
    """MON4: drift values stamped with the run time, ready to append."""
    return results.select((F.current_timestamp() if run_at is None else run_at).alias("run_at"), "feature", "metric", "value", "severity")


PROGRESS_DDL = "query string, batch_id long, source string, input_rows long, late_rows long, end_offset string, latest_offset string"


def _progress_rows(p: dict) -> list[tuple]:
    """One row for each source of a micro-batch, with the rows that came too late."""
    dropped = sum(int(o["numRowsDroppedByWatermark"]) for o in p["stateOperators"])
    return [(p["name"], p["batchId"], s["description"], int(s["numInputRows"]), dropped, str(s["endOffset"]), str(s.get("latestOffset"))) for s in p["sources"]]


class ProgressLog(StreamingQueryListener):
    """MON5: appends every micro-batch of every query to a table, however many there are.

    ``spark.streams.addListener(ProgressLog(spark, path))`` before the queries start. Read it with ``spark.read.parquet(path)``.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        rows = _progress_rows(json.loads(event.progress.json))
        if rows:
            self.spark.createDataFrame(rows, PROGRESS_DDL).coalesce(1).write.mode("append").parquet(self.path)


def stream_progress(query: StreamingQuery) -> DataFrame:
    """MON5 at a glance: the micro-batches the query still remembers; ``ProgressLog`` keeps all."""
    return SparkSession.active().createDataFrame([r for p in query.recentProgress for r in _progress_rows(json.loads(p.json))], PROGRESS_DDL)
