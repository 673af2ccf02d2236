"""Near-duplicate detection by 64-bit SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.llm.components import components
from riskflow.session import freeze

SHINGLE = 4
MAX_BITS = 4
#: (first bit, bits). MAX_BITS differences over three segments leave one segment with at most one of them.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
SEED = 42
#: From this many different fingerprints on, variants also hold one of PARTS exact parts of the other segments: 29 bits in place of 20.
DEEP_FROM = 1 << 26
PARTS = 5


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 hashes; 0 without a word.

    ASCII letters are lower-cased; fewer words than a shingle make one shingle. Nothing is cut off.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long), one row per document."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            marks = np.array([fingerprint(t, shingle) for t in column(batch, "text")], dtype=np.uint64)
            yield rows_out(schema, [column(batch, "doc_id"), marks.view(np.int64)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, "doc_id long, fp long")


def _mask(first: int, bits: int) -> int:
    m = ((1 << bits) - 1) << first
    return m - (1 << 64) if m >> 63 else m


def _segment(bit: int) -> tuple[int, int]:
    return next(s for s in SEGMENTS if s[0] <= bit < sum(s))


def _part_masks(segment: tuple[int, int]) -> list[int]:
    """The bits outside a segment in PARTS parts: MAX_BITS differences leave one of them equal."""
    other = [b for b in range(64) if not segment[0] <= b < sum(segment)]
    cuts = [len(other) * i // PARTS for i in range(PARTS + 1)]
    masks = [sum(1 << b for b in other[i:j]) for i, j in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def variants(prints: DataFrame, deep: bool = False) -> DataFrame:
    """64 rows a fingerprint: for each bit, its segment with this bit taken out (``bit``, ``rest``, ``fp``).

    ``deep``: PARTS rows for each of these, with one part of the other segments as well (``part``, ``also``).
    """
    held = lambda mask: F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
    made = []
    for bit in range(64):
        key = [F.lit(bit).cast("byte").alias("bit"), held(_mask(*_segment(bit)) & ~_mask(bit, 1)).alias("rest")]
        made += [[*key, F.lit(k).cast("byte").alias("part"), held(m).alias("also")] for k, m in enumerate(_part_masks(_segment(bit)))] if deep else [key]
    return prints.select("fp", F.explode(F.array(*[F.struct(*x) for x in made])).alias("x")).select("x.*", "fp")


def _first_shared(x: Column) -> Column:
    """The lowest bit whose variant two fingerprints with difference ``x`` share: a pair is emitted there alone."""
    out = F.lit(-1)
    for first, bits in reversed(SEGMENTS):
        part = F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        at = F.when(part == 0, F.lit(first)).otherwise(F.lit(first) + F.bit_count(part - 1))
        out = F.when(F.bit_count(part) <= 1, at).otherwise(out)
    return out


def _first_equal_part(x: Column) -> Column:
    """The first part outside the segment of ``bit`` in which two fingerprints with difference ``x`` are equal."""
    out = F.lit(-1)
    for segment in SEGMENTS:
        inside = F.col("l.bit").between(segment[0], sum(segment) - 1)
        for k, mask in reversed(list(enumerate(_part_masks(segment)))):
            out = F.when(inside & (x.bitwiseAND(F.lit(mask).cast("long")) == 0), F.lit(k)).otherwise(out)
    return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, deep: bool = False) -> DataFrame:
    """Every pair ``a < b`` of different fingerprints that differ in at most ``max_bits`` bits (4 at most), once.

    Verification is part of the join's condition, so candidates that fail are never rows. ``deep`` finds the same pairs from five times as
    many keys, each shared by chance 2**9 times less often.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"three segments find up to {MAX_BITS} differing bits")
    left, right = variants(prints, deep).alias("l"), variants(prints, deep).alias("r")
    a, b = F.col("l.fp"), F.col("r.fp")
    x = a.bitwiseXOR(b)
    same = (F.col("l.bit") == F.col("r.bit")) & (F.col("l.rest") == F.col("r.rest")) & (a < b)
    once = F.col("l.bit") == _first_shared(x)
    if deep:
        same = same & (F.col("l.part") == F.col("r.part")) & (F.col("l.also") == F.col("r.also"))
        once = once & (F.col("l.part") == _first_equal_part(x))
    return left.join(right, same & (F.bit_count(x) <= max_bits) & once).select(a.alias("a"), b.alias("b"))


def _grouped(docs: DataFrame, max_bits: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row; for each fingerprint its smallest doc_id and its component."""
    marked = freeze(fingerprints(docs, shingle))
    nodes = freeze(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    found = components(links(nodes.select("fp"), max_bits, nodes.count() >= DEEP_FROM), "a", "b")
    joined = nodes.join(found, nodes.fp == found.node, "left")
    return marked, freeze(joined.select("fp", "least", "rows", F.coalesce("component", "fp").alias("component")))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Documents link when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest doc_id
    reachable, the own one included. Equal fingerprints are one node, so groups of copies of any size make no pairs.
    Null and empty texts have fingerprint 0. A null doc_id takes part in linking and is never the smallest, unless its
    component has no other: then component_id is null. Repeated rows each get a row. An empty table gives an empty result.
    """
    marked, grouped = _grouped(docs, max_bits, shingle)
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, marked.fp == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates, all columns: of each component the row with the smallest doc_id.

    Rows without an id come last; of rows that repeat id and fingerprint one stays.
    """
    marked, grouped = _grouped(docs, max_bits, shingle)
    first = grouped.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("x"))
    chosen = first.select(F.col("x.fp").alias("_op3_fp"), F.col("x.least").alias("_op3_id"))
    same = (marked.fp == chosen["_op3_fp"]) & marked.doc_id.eqNullSafe(chosen["_op3_id"])
    chosen = marked.join(chosen, same).groupBy("_op3_fp", "_op3_id").agg(F.count("*").alias("_op3_n"))

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    own = docs.select("*", mark("text").alias("_op3_own"))
    held = own.join(chosen, (F.col("_op3_own") == F.col("_op3_fp")) & docs["doc_id"].cast("long").eqNullSafe(F.col("_op3_id")))
    repeated = held.where("_op3_n > 1").dropDuplicates(["_op3_fp", "_op3_id"])
    return held.where("_op3_n = 1").select(docs.columns).unionByName(repeated.select(docs.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
