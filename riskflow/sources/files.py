"""Table readers (SRC1-2) and the canonical layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskflow.schema import TXN
from riskflow.session import prepare


class DatasetNotFoundError(FileNotFoundError):
    """The table is not where the caller said; no other place is searched."""

    def __init__(self, path: str) -> None:
        self.path = path
        super().__init__(f"no transactions table at {path!r}")


def _open(read, path: str) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            raise DatasetNotFoundError(path) from e
        raise


def _shape(df: DataFrame, columns: Sequence[str] | None, limit: int | None) -> DataFrame:
    if columns is not None:
        unknown = [c for c in columns if c not in df.columns]
        if unknown:
            raise ValueError(f"unknown columns: {unknown}")
        df = df.select(*columns)
    return df if limit is None else df.limit(limit)


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None, parse_dates: bool = True) -> DataFrame:
    """Scan the CSV with its fixed schema: a malformed row fails the job.

    Only an empty field is null, so codes such as ``NA`` stay text. With
    ``parse_dates=False`` the two time columns stay text. ``columns`` reaches the
    parser, which then skips the other fields.
    """
    fields = [
        f if parse_dates or not isinstance(f.dataType, T.TimestampType) else T.StructField(f.name, T.StringType(), True)
        for f in TXN.fields
    ]
    reader = (
        prepare(spark)
        .read.schema(T.StructType(fields))
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("nullValue", "")
    )
    return _shape(_open(reader.csv, path), columns, limit)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Read a parquet table; naive timestamps become UTC instants."""
    df = _open(prepare(spark).read.parquet, path)
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    df = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
    return _shape(df, columns, limit)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """The canonical layout: parquet by event date, so a time split reads only its days.

    Dates are rebalanced by size: adaptive execution splits a busy day over tasks and merges quiet ones; no file grows beyond ``rows_per_file``.
    """
    dated = df.withColumn("event_date", F.to_date("event_timestamp")).hint("rebalance", "event_date")
    dated.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("event_date").parquet(path)
