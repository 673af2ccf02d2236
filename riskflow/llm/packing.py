"""Packing tokenised documents into sequences: dominance reduction first, best fit for the rest.

Lengths are whole numbers up to the sequence length, so an instance of any size is a count per length. It is reduced and
packed as patterns with multiplicities; Spark numbers the pieces of each length and puts number r into its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.functions.prefix import running_totals
from riskflow.llm.common import column, rows_out, slices, table
from riskflow.llm.tokens import encoder
from riskflow.session import freeze

LENGTH = 2048
END_ID = 0
#: Cells of the order in which pieces of one length are numbered.
CELL_BITS = 12

Pattern = tuple[tuple[int, int], ...]  # (length, how often), in the order of the sequence


def reduce_instance(counts: dict[int, int], size: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix sets that provably dominate every other set holding the same largest piece; return them and the rest.

    With room r beside a piece, k the longest other piece that fits: the piece goes alone if none fits; {piece, k} dominates if k fills r, if
    no two pieces fit r together, or if no three do and no two that do exceed k (they could take k's place elsewhere).
    """
    left, fixed = {n: c for n, c in counts.items() if c > 0}, []
    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while left.get(big, 0):
                room, ordered = size - big, sorted(left)
                others = lambda n: left[n] - (n == big)
                fitting = [n for n in ordered if n <= room and others(n) > 0]
                if not fitting:
                    fixed.append((((big, 1),), left.pop(big)))
                    changed = True
                    break
                k, small = fitting[-1], [n for n in fitting[:3] for _ in range(min(3, others(n)))][:3]
                pairs = len(small) > 1 and small[0] + small[1] <= room
                triples = len(small) > 2 and sum(small) <= room
                if k != room and pairs and (triples or _best_pair(fitting, others, room) > k):
                    break
                # the rule holds as long as both last: fewer pieces leave fewer rivals, and none of more length
                times = left[big] // 2 if k == big else min(left[big], left[k])
                fixed.append((((big, 2),) if k == big else ((big, 1), (k, 1)), times))
                changed = True
                for n in (big, k):
                    left[n] -= times
                for n in {big, k}:
                    if not left[n]:
                        del left[n]
    return fixed, left


def _best_pair(fitting: list[int], others, room: int) -> int:
    best, i, j = 0, 0, len(fitting) - 1
    while i <= j:
        total = fitting[i] + fitting[j]
        if total > room:
            j -= 1
        else:
            if i < j or others(fitting[i]) > 1:
                best = max(best, total)
            i += 1
    return best


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: each piece into the fullest open sequence that has room for it."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(pattern: Pattern, room: int, times: int) -> None:
        if not times:
            return
        if not room:
            done.append((pattern, times))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, times))

    for n in sorted(counts, reverse=True):
        rest = counts[n]
        while rest:
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, pattern, times = size, (), -(-rest // (size // n))
            # a sequence that just took a piece has the least room: it takes as many as fit
            each = room // n
            full = min(times, rest // each)
            put((*pattern, (n, each)), room - each * n, full)
            rest -= full * each
            times -= full
            if times and rest:
                put((*pattern, (n, rest)), room - rest * n, 1)
                rest, times = 0, times - 1
            put(pattern, room, times)
    return done + [x for room in rooms for x in open_[room]]


def solve(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_instance(counts, size)
    return fixed + best_fit(rest, size)


def places(patterns: list[tuple[Pattern, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the pieces of a length from number ``lo``: their first sequence and their offset, sorted by (length, lo)."""
    used: dict[int, int] = {}
    out, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for n, each in pattern:
            for _ in range(each):
                lo = used.get(n, 0)
                out.append(((n << 40) | lo, lo, base, offset))
                used[n] = lo + times
                offset += n
        base += times
    out.sort()
    key, lo, first, offset = (np.array(x, dtype=np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return key, lo, first, offset


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, size: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the closing id, cut only if they exceed ``size``.

    The first piece of a cut document takes what is left over by the others, which are full.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in slices(batches, 64):
            out = []
            for doc_id, ids in zip(column(batch, "doc_id"), code.encode([t or "" for t in column(batch, "text")])):
                data = memoryview(np.append(ids, END_ID).astype("<u4").tobytes())
                n = len(data) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                out += [(doc_id, i, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield rows_out(PIECES, zip(*out) if out else [[]] * 5)
        code.forget()  # an idle worker holds the vocabulary alone

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, size: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for all pieces of ``docs`` (``doc_id``, ``text``).

    Null and empty texts are one piece with the closing id alone. Rows with equal or null ids are packed each for itself;
    other columns are ignored. An empty table gives an empty result. What the driver holds are counts and patterns by
    length: it does not grow with the number of documents.
    """
    cut = freeze(pieces(docs, path, size))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(solve(counts, size)))
    place = F.xxhash64("doc_id", "piece", "ids_crc32")
    numbered = cut.withColumns({"place": place, "one": F.lit(1).cast("long")}).withColumn("cell", (F.shiftright("place", 64 - CELL_BITS)).cast("int"))
    numbered = running_totals(numbered, ["length"], ["cell"], ["place", "doc_id", "piece", "start"], ["one"])
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lo, first, offset = shared.value
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "one_before"))
            at = np.searchsorted(key, (n << 40) | r, side="right") - 1
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in PIECES]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + r - lo[at]), pa.array(offset[at])], schema=schema)

    chosen = numbered.select(*PIECES.names, "one_before")
    return chosen.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
