"""Runs of repeated words: maximal stretches that go on with one period for four periods or more.

Longest common extensions come from a difference cover: only suffixes at covered places are sorted, a pair of places is
compared for the few words up to the next pair of covered places, and a range minimum over the neighbours' common
prefixes gives the rest. Runs are looked for on a harmonic grid: for each period q, from every 2q-th word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, slices, table

#: Covered residues: every difference modulo MODULUS lies between two of them.
MODULUS = 13
COVER = (0, 1, 3, 9)
MIN_PERIODS = 4
MIN_WORDS = 6
#: Words of the documents that are searched at once (one longer document is searched alone), and grid points held at once.
BATCH_WORDS = 1 << 16
GRID_POINTS = 1 << 20

_residue = np.full(MODULUS, -1, dtype=np.int64)
_residue[list(COVER)] = np.arange(len(COVER))
#: Words from places of residues (a, b) to the next places that are both covered.
_shift = np.array([[next(h for h in range(MODULUS) if {(a + h) % MODULUS, (b + h) % MODULUS} <= set(COVER)) for b in range(MODULUS)] for a in range(MODULUS)])


class Extensions:
    """How many codes from place i on equal those from place j on; the last code must occur nowhere else."""

    def __init__(self, code: np.ndarray):
        self.n = n = len(code)
        self.code = np.concatenate([code, np.zeros(MODULUS, np.int64)])
        places = np.flatnonzero(_residue[np.arange(n) % MODULUS] >= 0)
        names = [self._first_names(places)]
        while names[-1].max(initial=0) + 1 < len(places):
            after = self._sample(places + (MODULUS << (len(names) - 1)))
            key = names[-1] * (len(places) + 1) + np.where(after >= 0, names[-1][after] + 1, 0)
            order = np.argsort(key, kind="stable")
            names.append(_dense(order, key[order][1:] != key[order][:-1]))
        self.rank, order = names[-1], np.argsort(names[-1])
        self.least = self._minima(self._neighbours(places[order], names))

    def _sample(self, place: np.ndarray) -> np.ndarray:
        """The number of a covered place among all; -1 beyond the end."""
        return np.where(place < self.n, place // MODULUS * len(COVER) + _residue[place % MODULUS], -1)

    def _first_names(self, places: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first MODULUS codes, as many codes to a sort key as it holds."""
        bits = max(1, int(self.code.max()).bit_length())
        keys = []
        for at in range(0, MODULUS, max(1, 62 // bits)):
            key = np.zeros(len(places), np.int64)
            for k in range(at, min(MODULUS, at + max(1, 62 // bits))):
                key = (key << bits) | self.code[places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differ = np.zeros(max(0, len(places) - 1), bool)
        for key in keys:
            differ |= key[order][1:] != key[order][:-1]
        return _dense(order, differ)

    def _neighbours(self, ordered: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of samples that are neighbours in the order, from the longest names down to single codes."""
        i, j = ordered[:-1], ordered[1:]
        common = np.zeros(len(i), np.int64)
        for t in range(len(names) - 2, -1, -1):
            a, b = self._sample(i + common), self._sample(j + common)
            common += ((a >= 0) & (b >= 0) & (names[t][a] == names[t][b])) * (MODULUS << t)
        live = np.ones(len(i), bool)
        for _ in range(MODULUS - 1):
            live &= self.code[i + common] == self.code[j + common]
            common += live
        return common

    @staticmethod
    def _minima(values: np.ndarray) -> np.ndarray:
        """Row k holds the least of 2**k values from each place on."""
        rows = [values]
        while 2 << (len(rows) - 1) <= len(values):
            half, last = 1 << (len(rows) - 1), rows[-1]
            rows.append(np.concatenate([np.minimum(last[:-half], last[half:]), last[-half:]]))
        return np.stack(rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """``i`` and ``j`` differ everywhere."""
        reach = _shift[i % MODULUS, j % MODULUS]
        out = reach.copy()
        live = np.arange(len(i))
        synchronised = [live[reach == 0]]
        live = live[reach > 0]
        for k in range(MODULUS):
            if not len(live):
                break
            same = self.code[i[live] + k] == self.code[j[live] + k]
            out[live[~same]] = k
            live = live[same]
            synchronised.append(live[reach[live] == k + 1])
            live = live[reach[live] > k + 1]
        at = np.concatenate(synchronised)
        a, b = (self.rank[self._sample(x[at] + reach[at])] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out[at] += np.minimum(self.least[level, low], self.least[level, high - (1 << level)])
        return out


def _dense(order: np.ndarray, differ: np.ndarray) -> np.ndarray:
    ranks = np.zeros(len(order), np.int64)
    ranks[order[1:]] = np.cumsum(differ)
    return ranks


def find_runs(code: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), sorted, of the runs of all documents in ``code``; no document's closing code occurs twice."""
    found = [np.zeros((0, 3), np.int64)]
    tops = lengths // MIN_PERIODS
    if not tops.sum():
        return found[0]
    common = Extensions(code)
    doc = np.repeat(np.arange(len(starts)), tops)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
    points = (lengths[doc] + q - 1) // (2 * q)
    ends = np.cumsum(points)
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GRID_POINTS, side="right")))
        here = np.repeat(np.arange(at, to), points[at:to])
        nth = np.arange(len(here)) - np.repeat(np.cumsum(points[at:to]) - points[at:to], points[at:to])
        period, first = q[here], starts[doc[here]]
        place = first + 2 * period * nth
        equal = code[place] == code[place + period]
        place, period, first = place[equal], period[equal], first[equal]
        ahead = common(place, place + period)
        # a run of four periods goes on for more than one from its first grid point
        enough = ahead > period
        place, period, first, ahead = place[enough], period[enough], first[enough], ahead[enough]
        back = _backwards(common, place, period, np.minimum(2 * period, place - first))
        own = (back < 2 * period) & (back + period + ahead >= np.maximum(MIN_WORDS, MIN_PERIODS * period))
        found.append(np.stack([place - back, place + period + ahead, period], axis=1)[own])
        at = to
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # multiples of a run's period give the same stretch again
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _backwards(common: Extensions, place: np.ndarray, period: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far each pair (place, place + period) goes on to the left, ``most`` at most, by bisection over extensions."""
    low, high = np.zeros(len(place), np.int64), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        left = place[open_] - middle
        holds = common(left, left + period[open_]) >= middle
        low[open_[holds]] = middle[holds]
        high[open_[~holds]] = middle[~holds] - 1
    return low


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("best", RUN), ("collapsed", pa.binary())])
FOUND_DDL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed binary"

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _search(docs: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    lengths = np.array([len(w) for _, w in docs], dtype=np.int64)
    known: dict[bytes, int] = {}
    n = int(lengths.sum())
    words = np.fromiter((known.setdefault(w, len(known)) for _, own in docs for w in own), dtype=np.int64, count=n)
    # each document is closed by a code of its own, so that nothing is common to two documents' ends
    starts = np.cumsum(lengths + 1) - lengths - 1
    code = np.zeros(n + len(docs), np.int64)
    closing = starts + lengths
    code[np.delete(np.arange(len(code)), closing)] = words
    code[closing] = len(known) + np.arange(len(docs))
    rows = find_runs(code, starts, lengths)
    dropped = np.zeros(len(code) + 1, np.int64)
    np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
    np.add.at(dropped, rows[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    of = np.searchsorted(starts, rows[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(docs) + 1))
    out = []
    for d, (doc_id, own) in enumerate(docs):
        here = [(int(s - starts[d]), int(e - s), int(q)) for s, e, q in rows[cuts[d] : cuts[d + 1]]]
        best = None
        for run in here:  # sorted by start and period, so that of equal exponents the first stays
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        rest = [w for w, k in zip(own, kept[starts[d] :].tolist()) if k] if here else own
        as_dict = lambda r: r and dict(zip(("start", "length", "period"), r))
        out.append((doc_id, len(own), [as_dict(r) for r in here], as_dict(best), b" ".join(rest)))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, best, collapsed`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    ``runs`` are sorted by start and period; ``best`` has the greatest exponent (null without runs); ``collapsed`` are the words left when of
    each run all but its first period goes. ``rewrite`` may change a document's words first. Null, empty and blank texts have
    no words and no runs; rows with equal or null ids are searched each for itself. A text of any length is searched
    whole, in memory in proportion to its words. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in slices(batches, 64):
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text")):
                own = (text or b"").split()
                own = rewrite(doc_id, own) if rewrite else own
                if held and words + len(own) > BATCH_WORDS:
                    yield _search(held)
                    held, words = [], 0
                held.append((doc_id, own))
                words += len(own)
        if held:
            yield _search(held)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return own.mapInArrow(work, FOUND_DDL).withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: every tenth document by the crc32 of its id goes on periodically from some word; one without id is left alone."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
