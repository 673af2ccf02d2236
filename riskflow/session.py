"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The JVM interprets longer methods for good; Spark then runs such a stage in smaller methods, which are compiled.
COMPILED_BYTES = 8000


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results and the cost of wide rows depend on; leave resources to whoever started the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, str(min(int(spark.conf.get(limit)), COMPILED_BYTES)))
    return spark


def local_session(cores: str | int = "*", name: str = "riskflow", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("RISKFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="riskflow-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared checkpoint folder, for tables that are read several times, a few columns at a time."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
