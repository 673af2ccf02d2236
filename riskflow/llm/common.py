"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.session import checkpoint_dir

#: The white space of every word rule here: space, \t, \n, \v, \f, \r. ``bytes.split()`` splits on exactly these.
SPACE = " \t\n\u000b\f\r"
SPACE_BYTES = SPACE.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Settings of the C library and of Arrow for Python workers: blocks of a megabyte and more go back to the system when they are freed, so that
#: a worker that waits for its next task holds little.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver does; on a cluster it is installed or sent there. Their memory settings, unless the session has its own."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    root, known = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known.get("PYTHONPATH", "")]))


def sent_if_small(written: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table of few narrow rows as the broadcast side of a join; one of more than ``rows`` is left to a shuffle."""
    return F.broadcast(written) if written.count() <= rows else written


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, which is smaller than a checkpoint of it."""
    path = f"{checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def rows_out(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python holds at once stays small whatever Spark sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers over all their bits (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
