"""Exact top-k search by inner product, a block of candidates at a time.

Candidates are put in an order that keeps similar vectors together and cut into blocks; a block holds its vectors (its
forward index) and, for each dimension, the greatest and least component (its term maxima, for positive and negative query
weights). A query takes blocks by their summed maxima, greatest first, and stops where no bound reaches its k-th score.
Blocks form shards of consecutive blocks, with maxima of their own: a query first searches its best shard, and then only
those whose bound reaches the k-th score found there. Nothing is skipped that could be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.session import freeze

BLOCK = 64
#: Vectors of a shard, at least; the shards' maxima, which every worker gets, take ``SUMMARY_BYTES`` about (twice that at most).
SHARD = 1024
SUMMARY_BYTES = 16 << 20
#: Vectors with the smallest hash that set the order of all (results don't depend on it), and bytes of them at most.
PIVOTS = 256
PIVOT_BYTES = 8 << 20
#: Queries that are scored at once, and about so many a task: shards that more queries visit are dealt to several tasks.
QUERIES_AT_ONCE = 512
QUERIES_A_TASK = 1 << 18
LEAST, MOST = -(2**63), 2**63 - 1

BLOCKS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
BLOCKS_DDL = "shard long, block long, rows array<long>, ids array<long>, vectors binary, high binary, low binary"


class Numbers:
    """How integers up to ``big`` are multiplied without error: as doubles while sums stay below 2**53, else as Python's integers."""

    def __init__(self, big: int, dims: int):
        self.dims, self.stored = dims, next(t for t in ("<i2", "<i4", "<i8") if big <= np.iinfo(t).max)
        self.kind = np.float64 if big * big * max(1, dims) < 2**53 else object

    def write(self, vectors: np.ndarray) -> bytes:
        return np.ascontiguousarray(vectors, dtype=self.stored).tobytes()

    def read(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.stored).reshape(-1, self.dims).astype(self.kind)

    def padded(self, vectors: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(vectors), self.dims), dtype=np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def product(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products of rows; those beyond 64 bits are the nearest number of 64 bits."""
        got = a @ b.T
        return (np.clip(got, -MOST, MOST) if self.kind is object else got).astype(np.int64)

    def bounds(self, queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The greatest product that a vector between ``low`` and ``high`` can have with each query."""
        return self.product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), np.concatenate([high, low], axis=1))


def blocks_of(rows: DataFrame, n: int, numbers: Numbers) -> DataFrame:
    """The block index of all ``rows`` (``row, vec_id, vector``), written."""
    dims = numbers.dims
    chosen = rows.orderBy(F.xxhash64("vec_id", "vector"), "row").limit(max(1, min(PIVOTS, PIVOT_BYTES // (8 * max(1, dims))))).select("vector").collect()
    pivots = numbers.padded([r["vector"] for r in chosen]).astype(np.float64)
    shards = max(1, min(-(-n // SHARD), SUMMARY_BYTES // (16 * max(1, dims))))
    per_shard = -(-n // shards)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = numbers.padded(column(batch, "vector")).astype(np.float64) @ pivots.T
            near = own.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(own[np.arange(len(own)), near])], names=[*batch.schema.names, "pivot", "near"])

    placed = rows.select("row", "vec_id", "vector").mapInArrow(place, "row long, vec_id long, vector array<long>, pivot long, near double")
    # the row is part of the order, so that equal vectors are cut apart like others
    ordered = placed.repartitionByRange(shards, "pivot", "near", "row").sortWithinPartitions("pivot", "near", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, held = TaskContext.get().partitionId() << 32, 0, []

        def block() -> pa.RecordBatch:
            vectors = numbers.padded([v for _, _, v in held])
            at = done // BLOCK
            return rows_out(BLOCKS, [[part | (done // per_shard)], [at], [[r for r, _, _ in held]], [[i for _, i, _ in held]], [numbers.write(vectors)],
                                     [numbers.write(vectors.max(axis=0, keepdims=True))], [numbers.write(vectors.min(axis=0, keepdims=True))]])

        for batch in slices(batches):
            for row in zip(*(column(batch, c) for c in ("row", "vec_id", "vector"))):
                held.append(row)
                if len(held) == BLOCK:
                    yield block()
                    done, held = done + BLOCK, []
        if held:
            yield block()

    return freeze(ordered.select("row", "vec_id", "vector").mapInArrow(cut, BLOCKS_DDL))


def summary(blocks: DataFrame, numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shard, high, low`` of all shards, whose number is bounded by ``SUMMARY_BYTES``."""
    schema = pa.schema([("shard", pa.int64()), ("high", pa.binary()), ("low", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = high = low = None
        for batch in slices(batches):
            for s, h, w in zip(*(column(batch, c) for c in schema.names)):
                h, w = numbers.read(h), numbers.read(w)
                if s != shard:
                    if shard is not None:
                        yield rows_out(schema, [[shard], [numbers.write(high)], [numbers.write(low)]])
                    shard, high, low = s, h, w
                high, low = np.maximum(high, h), np.minimum(low, w)
        if shard is not None:
            yield rows_out(schema, [[shard], [numbers.write(high)], [numbers.write(low)]])

    found = sorted(blocks.select(*schema.names).mapInArrow(work, "shard long, high binary, low binary").collect(), key=lambda r: r["shard"])
    return np.array([r["shard"] for r in found], dtype=np.int64), *(np.concatenate([numbers.read(bytes(r[c])) for r in found]) for c in ("high", "low"))


class Shard:
    """The blocks of one shard, in memory."""

    def __init__(self, numbers: Numbers):
        self.numbers, self.rows, self.ids, self.blocks, self.high, self.low = numbers, [], [], [], [], []

    def add(self, rows: list[int], ids: list[int | None], vectors: bytes, high: bytes, low: bytes) -> None:
        self.rows.append(np.array(rows, dtype=np.int64))
        self.ids.append(ids)
        self.blocks.append(self.numbers.read(vectors))
        self.high.append(self.numbers.read(high))
        self.low.append(self.numbers.read(low))

    def search(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places (block * BLOCK + number) of each query's best ``k`` that reach its floor; LEAST where there are fewer.

        Of equal scores the smaller id wins, a missing id last.
        """
        order = [MOST if i is None else i for ids in self.ids for i in [*ids, *[MOST] * (BLOCK - len(ids))]]
        by_id = np.array(order, dtype=np.int64)
        absent = np.array([i is None for ids in self.ids for i in [*ids, *[None] * (BLOCK - len(ids))]])
        m = len(queries)
        scores, places = np.full((m, k), LEAST, np.int64), np.zeros((m, k), np.int64)
        bound = self.numbers.bounds(queries, np.concatenate(self.high), np.concatenate(self.low))
        turn = np.argsort(~bound, axis=1, kind="stable")
        kth = floor.copy()
        for step in range(turn.shape[1]):
            here = turn[:, step]
            open_ = np.flatnonzero(bound[np.arange(m), here] >= kth)
            if not len(open_):
                break
            here = here[open_]
            by_block = np.argsort(here, kind="stable")
            for some in np.split(by_block, np.flatnonzero(np.diff(here[by_block])) + 1):
                if not len(some):
                    continue
                b, who = here[some[0]], open_[some]
                got = self.numbers.product(queries[who], self.blocks[b])
                got[own[who][:, None] == self.rows[b][None, :]] = LEAST
                better = (got >= kth[who][:, None]).any(axis=1)
                who, got = who[better], got[better]
                if not len(who):
                    continue
                got[got < kth[who][:, None]] = LEAST
                all_scores = np.concatenate([scores[who], got], axis=1)
                all_places = np.concatenate([places[who], np.broadcast_to(b * BLOCK + np.arange(got.shape[1]), got.shape)], axis=1)
                best = np.lexsort((absent[all_places], by_id[all_places], ~all_scores), axis=1)[:, :k]
                scores[who], places[who] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_places, best, 1)
                kth[who] = np.maximum(kth[who], scores[who][:, -1])
        return scores, places


VISITS_DDL = "shard long, row long, vec_id long, floor long, vectors binary"
PARTIAL = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def visited(blocks: DataFrame, visits: DataFrame, numbers: Numbers, k: int, queries: int) -> DataFrame:
    """``row, query_id, vec_id, score``: for each visit the shard's best ``k`` for the query.

    Blocks and queries of a shard meet in one order, blocks first: a task holds one shard and ``QUERIES_AT_ONCE`` queries.
    """
    salts = -(-queries // QUERIES_A_TASK)
    null = lambda kind: F.lit(None).cast(kind)
    first = blocks.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.col("block").alias("row"), null("long").alias("vec_id"),
                          null("long").alias("floor"), "vectors", "rows", "ids", "high", "low")
    then = visits.select("shard", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "row", "vec_id", "floor", "vectors",
                         null("array<long>").alias("rows"), null("array<long>").alias("ids"), null("binary").alias("high"), null("binary").alias("low"))
    names = first.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, held = None, None, []

        def answer() -> pa.RecordBatch:
            own, ids, floors, vectors = zip(*held)
            scores, places = shard.search(np.array(own, dtype=np.int64), numbers.read(b"".join(vectors)), np.array(floors, dtype=np.int64), k)
            who, nth = np.nonzero(scores > LEAST)
            found = places[who, nth]
            return rows_out(PARTIAL, [[own[i] for i in who], [ids[i] for i in who], [shard.ids[p // BLOCK][p % BLOCK] for p in found], scores[who, nth]])

        for batch in slices(batches, 256):
            for s, salt, kind, row, vec_id, floor, vectors, rows, ids, high, low in zip(*(column(batch, c) for c in names)):
                if (s, salt) != at or len(held) == QUERIES_AT_ONCE:
                    if held and shard.blocks:
                        yield answer()
                    held = []
                    if (s, salt) != at:
                        at, shard = (s, salt), Shard(numbers)
                if kind == 0:
                    shard.add(rows, ids, vectors, high, low)
                else:
                    held.append((row, vec_id, floor, vectors))
        if held and shard.blocks:
            yield answer()

    met = first.unionByName(then).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "row")
    return met.mapInArrow(work, "row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id`` long, ``vector`` array of longs) that ``is_query`` marks,
    the ``k`` greatest inner products with the other rows, all of them if there are fewer.

    Of equal scores the smaller ``vec_id`` comes first, a missing one last. Null vectors, and those that hold null, take no part. Shorter
    vectors count as filled up with zeros. Rows that share an id are searched, and found, each for itself: only a
    query's own row is left out. Scores beyond 64 bits are the nearest such number. Other columns are ignored; an
    empty table gives an empty result.
    """
    usable = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = freeze(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "vector", F.coalesce(is_query, F.lit(False)).alias("asks")).where(usable))
    known = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("queries"), F.max(F.size("vector")).alias("dims"),
                     F.max(F.greatest(F.coalesce(F.array_max("vector"), F.lit(0)), -1 - F.coalesce(F.array_min("vector"), F.lit(0)))).alias("big")).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not known["n"] or not known["queries"]:
        return empty
    numbers = Numbers(known["big"] + 1 if known["big"] < MOST else MOST, known["dims"])
    blocks = blocks_of(rows, known["n"], numbers)
    shared = rows.sparkSession.sparkContext.broadcast(summary(blocks, numbers))
    asking = rows.where("asks").select("row", "vec_id", "vector")
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("floor", pa.int64()), ("vectors", pa.binary())])

    def visits(first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, high, low = shared.value
            for batch in slices(batches, 256):
                vectors = numbers.padded(column(batch, "vector"))
                bound = numbers.bounds(vectors.astype(numbers.kind), high, low)
                best = bound.argmax(axis=1)
                own, ids = column(batch, "row"), column(batch, "vec_id")
                if first:
                    who, where, floors = np.arange(len(own)), best, [-MOST] * len(own)
                else:
                    floors = [-MOST if f is None else f for f in column(batch, "floor")]
                    reach = bound >= np.array(floors, dtype=np.int64)[:, None]
                    reach[np.arange(len(own)), best] = False
                    who, where = np.nonzero(reach)
                for at in range(0, len(who), 1 << 12):
                    some, to = who[at : at + (1 << 12)], where[at : at + (1 << 12)]
                    yield rows_out(schema, [shard[to], [own[i] for i in some], [ids[i] for i in some], [floors[i] for i in some], [numbers.write(vectors[i]) for i in some]])

        return work

    nearest = freeze(visited(blocks, asking.mapInArrow(visits(True), VISITS_DDL), numbers, k, known["queries"]))
    floors = nearest.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = asking.join(floors, "row", "left").mapInArrow(visits(False), VISITS_DDL)
    found = nearest.union(visited(blocks, others, numbers, k, known["queries"]))
    # at most k rows of a query from each shard
    window = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    whole = F.when(F.forall(x, finite), F.transform(x, lambda v: F.floor(F.lit(1024.0) * v.cast("double"))))
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("vector")), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.c, d.c) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
WHERE rank <= 10
"""
