"""Streaming jobs: scoring with fan-out and dead letters, monitoring, counters.

Every sink below writes one folder per micro-batch and overwrites it when Spark
repeats the batch after a failure, so a restart neither loses nor doubles rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.operators.monitoring import decision_counts
from riskflow.operators.velocity import entity_rows, widen
from riskflow.plans.features import finish, row_features
from riskflow.plans.scoring import Scorer
from riskflow.sources.kafka import route
from riskflow.sources.sinks import append_audit, audit_rows
from riskflow.streaming.ingest import accepted, dead_letters, validate_messages
from riskflow.streaming.state import stream_history


def _start(df: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, name: str, continuous: str | None) -> StreamingQuery:
    writer = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(handler)
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


def _put(df: DataFrame, folder: str, batch_id: int, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(f"{folder}/batch_id={batch_id}")


def validation_job(raw: DataFrame, out: str, checkpoint: str, contract: str = "online", continuous: str | None = None) -> StreamingQuery:
    """QLT10, SNK2: valid rows and dead letters of each micro-batch, parsed once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        parsed = batch.persist()
        _put(accepted(parsed), f"{out}/validated", batch_id)
        _put(dead_letters(parsed), f"{out}/dead_letter", batch_id, "json")
        parsed.unpersist()

    return _start(validate_messages(raw, contract), handle, checkpoint, "validation", continuous)


def screening_job(raw: DataFrame, out: str, checkpoint: str, lateness: str = "1 hour", contract: str = "online", continuous: str | None = None) -> StreamingQuery:
    """What comes before the stateful step: each message is accepted, late or dead, and none is lost.

    A valid row is late if it lies more than ``lateness`` before the newest row of all earlier micro-batches; the stateful step would drop it. It
    goes to ``late`` with the decision REVIEW, and to that decision's topics. ``accepted`` messages are what ``scoring_job`` reads
    (``read_accepted``). ``marks`` keeps, for each micro-batch, the newest time so far and the four counts, in = accepted + late + dead;
    a repeated micro-batch starts from its predecessor's mark and overwrites its own folders.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, parsed = batch.sparkSession, batch.persist()
        newest = spark.read.parquet(f"{out}/marks/batch_id={batch_id - 1}").first()["newest_us"] if batch_id else None
        valid = F.col("error").isNull()
        late = F.lit(False) if newest is None else valid & F.coalesce(F.col("event_timestamp") < F.expr(f"timestamp_micros({newest}) - INTERVAL {lateness}"), F.lit(False))
        _put(parsed.where(valid & ~late).select("key", "value"), f"{out}/accepted", batch_id)
        reviewed = parsed.where(late).select("transaction_id", "event_timestamp", "value", F.lit("REVIEW").alias("decision"),
                                             (F.lit(newest).cast("long") - F.unix_micros("event_timestamp")).alias("behind_us"), F.lit("late").alias("reason"))
        _put(reviewed, f"{out}/late", batch_id)
        _put(route(reviewed.select("transaction_id", "decision", "reason")), f"{out}/late_topics", batch_id, "json")
        _put(dead_letters(parsed), f"{out}/dead_letter", batch_id, "json")
        high = F.max(F.when(valid, F.unix_micros("event_timestamp")))
        _put(parsed.agg(F.greatest(F.lit(newest).cast("long"), high).alias("newest_us"), F.count("*").alias("n_in"), F.count_if(valid & ~late).alias("n_accepted"),
                        F.count_if(late).alias("n_late"), F.count_if(~valid).alias("n_dead")), f"{out}/marks", batch_id)
        parsed.unpersist()

    return _start(validate_messages(raw, contract), handle, checkpoint, "screening", continuous)


def read_accepted(spark: SparkSession, out: str, max_files: int | None = None) -> DataFrame:
    """The accepted messages of ``screening_job`` as a stream, oldest first."""
    reader = spark.readStream.schema("key string, value string, batch_id long")
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(f"{out}/accepted").select("key", "value")


def scoring_job(raw: DataFrame, scorer: Scorer, out: str, checkpoint: str, lateness: str = "1 hour", initial: DataFrame | None = None, continuous: str | None = None) -> StreamingQuery:
    """DEC8, SNK3, SNK5 on valid messages: entity state, features, model, decision, topics, audit.

    The six entity rows of a transaction leave the stateful step in the same
    micro-batch and are put side by side there. The audit has the time from the micro-batch's start to its scores. Rows that
    are invalid or too late are ``screening_job``'s, which runs before.
    """
    exact = any("_txn_count_" in f for f in scorer.model.features)
    messages = validate_messages(raw)
    history = stream_history(messages.where("error IS NULL"), lateness, payload="value", initial=initial)

    def handle(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        wide = widen(batch, ENTITIES, WINDOWS_US if exact else None, carry=["payload"], by=("transaction_id", "us", "seq")).drop("us", "seq")
        rows = validate_messages(wide.withColumnRenamed("transaction_id", "_id"), value="payload")
        past = [c for c in wide.columns if c not in ("transaction_id", "payload")]
        features = finish(row_features(rows, scorer.encoder, ["transaction_id", "event_timestamp", *past]), scorer.model.features, ["transaction_id", "event_timestamp"])
        scored = scorer.score_features(features, ["transaction_id", "event_timestamp"]).persist()
        _put(scored, f"{out}/scored", batch_id)  # computes the scores
        _put(route(scored), f"{out}/topics", batch_id, "json")
        took = (time.monotonic() - began) * 1000
        append_audit(audit_rows(scored.withColumn("_took", F.lit(took)), scorer.model.version, latency="_took"), f"{out}/audit", batch_id)
        scored.unpersist()

    return _start(history, handle, checkpoint, "scoring", continuous)


def monitoring_stream(scored: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """MON1 on a stream of scored rows; a window is emitted once the watermark passes it."""
    return decision_counts(scored.withWatermark("event_timestamp", lateness), width=width)


def gap_counter_stream(transactions: DataFrame, ttl_us: int = 3_600_000_000, lateness: str = "1 hour") -> DataFrame:
    """ST2 on a stream: counters that restart after a silence of at least ``ttl_us``, as in the batch.

    A session window still joins rows exactly its gap apart, so the gap is one microsecond shorter.
    """
    rows = entity_rows(transactions.withWatermark("event_timestamp", lateness), ENTITIES, ["event_timestamp"])
    return (
        rows.groupBy(F.session_window("event_timestamp", f"{ttl_us - 1} microseconds").alias("w"), "entity", "entity_id")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("amount_sum"), F.max("us").alias("end_us"))
        .select("entity", "entity_id", F.unix_micros(F.col("w.start")).alias("start_us"), "end_us", "txn_count", "amount_sum")
    )


def latest_value_stream(updates: DataFrame) -> DataFrame:
    """ST3 on a stream (update mode): the newest value of every (entity, feature), kept for good; ``streaming.state.live_values`` lets them expire."""
    return updates.groupBy("entity", "entity_id", "feature").agg(
        F.max_by("value", F.struct("us", "seq")).alias("value"), F.max("us").alias("us")
    )
