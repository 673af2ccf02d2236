"""Stream endpoints (SRC3, SNK1, SNK3): Kafka on a cluster, JSON folders with the same columns elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.config import TOPIC_ALERTS, TOPIC_BLOCKED, TOPIC_REVIEW, TOPIC_SCORED


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], max_offsets: int | None = None) -> DataFrame:
    """``key, value, topic`` from the earliest offset; progress lives in the query's checkpoint."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic")


def read_folder(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same columns from a folder of JSON lines ``{"key": …, "value": "…"}``."""
    reader = spark.readStream.schema("key string, value string, topic string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def messages(df: DataFrame, topic: str | Column | None = None, key: str = "transaction_id", drop: Sequence[str] = ()) -> DataFrame:
    """SNK1: one keyed JSON message per row; times as ISO text."""
    body = [c for c in df.columns if c not in drop]
    value = F.to_json(F.struct(*body), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"})
    target = F.lit(topic) if topic is None or isinstance(topic, str) else topic
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"), target.cast("string").alias("topic"))


def topics_of(decision: Column) -> Column:
    """SNK3: every scored row goes to the scored topic; reviewed and blocked rows also to
    their own, and a blocked row raises an alert."""
    return (
        F.when(decision == "BLOCK", F.array(F.lit(TOPIC_SCORED), F.lit(TOPIC_BLOCKED), F.lit(TOPIC_ALERTS)))
        .when(decision == "REVIEW", F.array(F.lit(TOPIC_SCORED), F.lit(TOPIC_REVIEW)))
        .otherwise(F.array(F.lit(TOPIC_SCORED)))
    )


def route(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One message per row and topic."""
    routed = df.select("*", F.explode(topics_of(F.col("decision"))).alias("_topic"))
    return messages(routed, F.col("_topic"), key, drop=["_topic"])


def write_kafka(df: DataFrame, servers: str) -> None:
    """Publish ``key, value, topic`` rows; acknowledged by all replicas, order kept per key."""
    (
        df.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all")
        .option("kafka.enable.idempotence", "true")
        .save()
    )


def write_folder(df: DataFrame, path: str, mode: str = "append") -> None:
    """The folder twin of :func:`write_kafka`, one sub-folder per topic."""
    df.write.mode(mode).partitionBy("topic").json(path)
