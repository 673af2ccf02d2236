"""Exact deduplication by a compressed exchange of fingerprints.

Every partition sends each owner of a hash range its sorted distinct hashes, Golomb-Rice coded. The owner answers with one
bit a hash: seen elsewhere or not. Only rows so suspected, or repeated within their partition, are read again and shuffled,
and their whole normalised texts are compared byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import SPACE, table
from riskflow.session import freeze

#: Bits of hash space above the row count: one row in 2**SPARE_BITS is suspected for nothing.
SPARE_BITS = 10
#: Hashes an owner decodes at once.
OWNER_ROWS = 1 << 20
#: Size of the filter that is broadcast, in bits: up to FILTER_MAX whatever the table's size. A full filter only sends more rows to verification.
FILTER_MIN, FILTER_MAX = 16, 27


def rice_bits(n: int, universe: int) -> int:
    """The remainder width that suits ``n`` hashes spread over ``universe`` values."""
    return max(0, int(np.log2(max(1, universe / max(1, n) * 0.69))))


def rice_encode(values: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Sorted distinct integers as Golomb-Rice codes of their gaps: the unary parts, then the remainders of ``width`` bits."""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    quotients, rest = gaps >> width, gaps & ((1 << width) - 1)
    unary = np.zeros(int(quotients.sum()) + len(values), dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    bits = (rest[:, None] >> np.arange(width)[None, :]).astype(np.uint8) & 1
    return np.packbits(unary).tobytes(), np.packbits(bits.reshape(-1)).tobytes()


def rice_decode(unary: bytes, rest: bytes, n: int, width: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * width].reshape(n, width).astype(np.int64)
    low = (bits << np.arange(width)[None, :]).sum(axis=1) if width else np.zeros(n, dtype=np.int64)
    return np.cumsum((quotients << width) + low + 1) - 1


MESSAGE = pa.schema([("owner", pa.int32()), ("sender", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("unary", pa.binary()), ("rest", pa.binary())])
MESSAGE_DDL = "owner int, sender int, n int, width int, unary binary, rest binary"
REPLY = pa.schema([("sender", pa.int32()), ("owner", pa.int32()), ("seen", pa.binary())])
MARKED = pa.schema([("uid", pa.int64())])


def suspects(rows: DataFrame, n: int) -> DataFrame:
    """``uid`` of the rows whose hash occurs again, plus about one row in 2**SPARE_BITS.

    ``rows`` has ``uid``, ``sender`` (the partition it lies in) and ``fp`` (64 bits), and must be written, not recomputed.
    """
    space = min(62, max(1, n).bit_length() + SPARE_BITS)
    owners = 1 << max(4, (max(1, n) // OWNER_ROWS).bit_length())
    shift, span = np.uint64(64 - space), (1 << space) // owners

    def short(fp: np.ndarray) -> np.ndarray:
        return (fp.view(np.uint64) >> shift).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("sender").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if not sum(len(s) for s, _ in got):
            return
        sender, fp = (np.concatenate(x) for x in zip(*got))
        for who in np.unique(sender):
            own = np.unique(short(fp[sender == who]))
            cuts = np.searchsorted(own, np.arange(owners + 1) * span)
            out = []
            for k in np.flatnonzero(np.diff(cuts)):
                part = own[cuts[k] : cuts[k + 1]] - k * span
                width = rice_bits(len(part), span)
                out.append((int(k), int(who), len(part), width, *rice_encode(part, width)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), MESSAGE)], schema=MESSAGE)

    def answer(messages: pa.Table) -> pa.Table:
        sent = messages.to_pylist()
        values = [rice_decode(m["unary"], m["rest"], m["n"], m["width"]) for m in sent]
        known, counts = np.unique(np.concatenate(values), return_counts=True)
        again = known[counts > 1]
        bits = [np.packbits(np.isin(v, again, assume_unique=True)).tobytes() for v in values]
        return pa.table([pa.array([m["sender"] for m in sent], pa.int32()), pa.array([m["owner"] for m in sent], pa.int32()), pa.array(bits, pa.binary())], schema=REPLY)

    def mark(own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return MARKED.empty_table()
        values, inverse, counts = np.unique(short(own["fp"].to_numpy()), return_inverse=True, return_counts=True)
        cuts = np.searchsorted(values, np.arange(owners + 1) * span)
        seen = counts > 1
        for owner, bits in zip(replies["owner"].to_pylist(), replies["seen"].to_pylist()):
            i, j = cuts[owner], cuts[owner + 1]
            seen[i:j] |= np.unpackbits(np.frombuffer(bits, np.uint8))[: j - i].astype(bool)
        return pa.table([own["uid"].filter(pa.array(seen[inverse]))], schema=MARKED)

    messages = rows.select("sender", "fp").mapInArrow(send, MESSAGE_DDL)
    replies = messages.groupBy("owner").applyInArrow(answer, "sender int, owner int, seen binary")
    return rows.select("sender", "uid", "fp").groupBy("sender").cogroup(replies.groupBy("sender")).applyInArrow(mark, "uid long")


def may_hold(fps: DataFrame, n: int, fp: str):
    """A column test that is true for every value in ``fps`` and for few others; what is broadcast is at most 2**FILTER_MAX bits."""
    bits = min(FILTER_MAX, max(FILTER_MIN, max(1, n).bit_length() + 4))
    chunk = min(bits, 19)

    def fold(part: pa.Table) -> pa.Table:
        flags = np.zeros(1 << chunk, dtype=np.uint8)
        flags[part["low"].to_numpy()] = 1
        return pa.table([part["high"].slice(0, 1), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["high", "bits"])

    slot = fps.select(F.col(fp).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("slot")).distinct()
    split = slot.select(F.shiftright("slot", chunk).cast("int").alias("high"), F.col("slot").bitwiseAND(F.lit((1 << chunk) - 1).cast("long")).alias("low"))
    found = split.groupBy("high").applyInArrow(fold, "high int, bits binary").toArrow()
    whole = np.zeros(1 << bits, dtype=np.uint8).reshape(-1, 1 << chunk)
    for high, packed in zip(found["high"].to_pylist(), found["bits"].to_pylist()):
        whole[high] = np.unpackbits(np.frombuffer(packed, np.uint8))
    shared = fps.sparkSession.sparkContext.broadcast(np.packbits(whole.reshape(-1)))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        at = values.to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
        return pd.Series((shared.value[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1)

    return test


def _keys(docs: DataFrame) -> list:
    """Normalised text, its digest and hash, of any table with a ``text`` column."""
    plain = F.translate(F.coalesce(docs["text"], F.lit("")), SPACE, "")
    return [plain.alias("_op5_text"), F.sha2(plain.cast("binary"), 256).alias("_op5_sha"), F.xxhash64(plain).alias("_op5_fp")]


def _decided(docs: DataFrame):
    """Rows (written), classes of equal texts (written), and the test of what may be in a class."""
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.char_length(F.coalesce(docs["text"], F.lit(""))).alias("n_chars"), *_keys(docs)[1:])
    rows = freeze(own.select(F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("sender"), "doc_id", "n_chars",
                             F.unhex("_op5_sha").alias("sha"), F.col("_op5_fp").alias("fp")))
    n = rows.count()
    suspected = freeze(rows.join(suspects(rows, n), "uid").select("uid", "doc_id", "n_chars", "sha", "fp"))
    test = may_hold(suspected, suspected.count(), "fp")
    texts = docs.select(_keys(docs)).where(test("_op5_fp")).groupBy("_op5_sha", "_op5_text").agg(F.count("*").alias("size"))
    # one row for each digest: its texts were compared as bytes; two texts with one digest would end the job
    verified = texts.groupBy("_op5_sha").agg(F.max("size").alias("size"), F.count("*").alias("texts")).where("size > 1")
    verified = verified.select(F.unhex("_op5_sha").alias("_sha"), F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("one digest, two texts"))).alias("size"))
    best = suspected.groupBy("sha").agg(F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("some"), (-F.col("doc_id")).alias("order"), (-F.col("uid")).alias("first"))).alias("x"))
    classes = freeze(best.join(verified, best.sha == F.col("_sha")).select("_sha", "size", (-F.col("x.order")).alias("keep"), (-F.col("x.first")).alias("first")))
    return rows, classes, test


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Texts are equal when identical without white space (space, \\t, \\n, \\v, \\f, \\r); null counts as empty. The row with the most code points stays, then
    the smallest doc_id (null last), then the first in the table: of repeated rows one is kept. An empty table gives an empty result.
    """
    rows, classes, _ = _decided(docs)
    alone = F.col("size").isNull()
    return rows.join(classes, rows.sha == classes["_sha"], "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns. Rows that have no possible copy are not shuffled."""
    _, classes, test = _decided(docs)
    wide = docs.select("*", *_keys(docs))
    clean = wide.where(~test("_op5_fp")).select(docs.columns)
    doubt = wide.where(test("_op5_fp")).join(classes.select("_sha", F.col("keep").alias("_op5_keep"), F.col("size").alias("_op5_size")), F.unhex("_op5_sha") == F.col("_sha"), "left")
    single = doubt.where("_op5_size is null").select(docs.columns)
    longest = F.char_length(F.coalesce(docs["text"], F.lit("")))
    chosen = doubt.where(F.col("_op5_size").isNotNull() & docs["doc_id"].cast("long").eqNullSafe(F.col("_op5_keep"))).withColumn("_op5_long", longest)
    top = chosen.groupBy("_op5_sha").agg(F.max("_op5_long").alias("_op5_most")).withColumnRenamed("_op5_sha", "_op5_of")
    chosen = chosen.join(top, (F.col("_op5_sha") == F.col("_op5_of")) & (F.col("_op5_long") == F.col("_op5_most"))).dropDuplicates(["_op5_sha"])
    return clean.unionByName(single).unionByName(chosen.select(docs.columns))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
