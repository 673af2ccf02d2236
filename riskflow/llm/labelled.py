"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a classifier is fitted on at most: those with the smallest hash of their id.
SAMPLE = 20_000
FOLDS = 5
#: Partitions of the sample, whatever the table has: a step of a fit sends the driver one vector from each.
PARTS = 16


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from. A missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: Column, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents that are not held out; null labels are left out.

    The sample's size is fixed by ``rows``, so that its ids can be sent to every worker.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), label.cast("double").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(chosen), "doc_id").repartition(PARTS, F.xxhash64("doc_id"))
