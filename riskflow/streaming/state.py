"""ST1, ST3: entity state on a stream, one keyed processor for all entities.

State per cell of hashed keys: for each hour bucket of the last seven days (and the permitted lateness) its rows and, per key, their count, sum, mean,
squared deviation and last time, and the same moments of everything before. A row reads them as of its own time: moments of its key's whole buckets, rows of the
few buckets at a window's edges. So a late row sees what the batch shows it, and only touched buckets are written again. Buckets that
no window reaches any more are merged into the older moments; an event-time timer does so for a cell that went quiet.

A call to the state store or a row that Python reads by itself costs as much as hundreds of rows in arrays. So rows reach the processor
packed, all those of a cell that lie together in one value, all keys of a cell are answered at once, and answers leave packed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.operators.entity_state import BUCKET_US, LATENESS_US

# The processor travels with the query, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("n_prior", T.LongType()),
        T.StructField("avg_prior", T.DoubleType()),
        T.StructField("std_prior", T.DoubleType()),
        T.StructField("prev_us", T.LongType()),
        *[T.StructField(f"{k}_{w}", T.LongType() if k == "n" else T.DoubleType()) for w in WINDOWS_US for k in ("n", "sum")],
        # True when later rows of the key came in an earlier micro-batch: they were answered without this one.
        T.StructField("out_of_order", T.BooleanType()),
        # The message itself, carried by one entity's row only.
        T.StructField("payload", T.StringType()),
    ]
)
_ROW = Row(*OUTPUT.fieldNames())
_PACKED = Row("packed")
_WIDE = np.longdouble  # sums are differences of running totals, so they are kept longer than a double

#: Cells of hashed keys; state is laid out by them, so a checkpoint keeps the number it began with.
CELLS = 1024
#: Transactions whose rows are packed together, and rows of a cell that are answered together (a key's rows always are).
PACK_ROWS, ANSWER_ROWS = 1 << 16, 1 << 17

#: A key is an entity's name, a colon and the id.
_FRESH = pa.schema([("key", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("amount", pa.float64()), ("id", pa.string()), ("payload", pa.string())])
_STORED = pa.schema([("key", pa.string()), ("us", pa.int64()), ("seq", pa.int64()), ("amount", pa.float64()), ("id", pa.string())])
_MOMENTS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("total", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64()), ("last_us", pa.int64())])
_ANSWER = to_arrow_schema(OUTPUT)


def _pack(schema: pa.Schema, columns: Iterable) -> bytes:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema)], schema=schema).serialize().to_pybytes()


def _unpack(packed: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(packed)), schema)


def _joined(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.concat_arrays([b.column(i) for b in batches]) if batches else pa.array([], f.type) for i, f in enumerate(schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _codes(keys: pa.Array, names: pa.Array) -> np.ndarray:
    return pc.index_in(keys, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


class EntityHistory(StatefulProcessor):
    """Rows of one key, as they are."""

    def __init__(self, windows: Mapping[str, int] = WINDOWS_US, lateness_us: int = LATENESS_US, bucket_us: int = BUCKET_US) -> None:
        self.windows, self.bucket_us = dict(windows), bucket_us
        self.keep_us = max(self.windows.values()) + lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.older = handle.getValueState("older", "n bigint, packed binary, timer bigint")
        self.moments = handle.getMapState("moments", "bucket bigint", "packed binary")
        self.rows = handle.getMapState("rows", "bucket bigint", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = [(f"{key[0]}:{key[1]}", r.us, r.seq, r.amount, r.transaction_id, r.payload) for r in rows]
        for answer in self._answered(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), _FRESH)], schema=_FRESH)):
            for values in answer.to_pylist():
                yield _ROW(*values.values())

    def _answered(self, fresh: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The rows with their history; the state then holds them. The micro-batch is bounded by the source's per-trigger limit."""
        if fresh.column("us").null_count:
            raise ValueError("a transaction has no time")
        names, older, timer, known = self._state(fresh.column("key"))
        stored = set(known.bucket.tolist())
        us, seq, amount = _numbers(fresh, "us", "seq", "amount")
        bucket = us // self.bucket_us
        # a key's number is the place of its first row among the fresh ones, so the keys asked for come first
        code = _codes(fresh.column("key"), names)
        asked = int(code.max()) + 1
        wanted = set(np.unique(bucket).tolist()).union(*[np.unique((us - w) // self.bucket_us).tolist() for w in self.windows.values()])
        read = {b: _unpack(self.rows.getValue((b,))[0], _STORED) for b in sorted(wanted & stored)}
        beside = _joined(list(read.values()), _STORED)
        seen = np.full(len(names), np.iinfo(np.int64).min)
        np.maximum.at(seen, known.code, known.last_us)
        np.maximum.at(seen, older.code, older.last_us)

        # the fresh rows and the stored rows of their keys, in the total order; ``new``: a row's place among the fresh, or -1
        beside_code = _codes(beside.column("key"), names)
        mine = np.flatnonzero(beside_code < asked)
        columns = [np.concatenate([a, b[mine]]) for a, b in zip((code, us, seq, amount), (beside_code, *_numbers(beside, "us", "seq", "amount")))]
        order = _in_order(*columns[:3], pa.concat_arrays([fresh.column("id"), beside.column("id").take(pa.array(mine))]))
        new = np.where(order < len(fresh), order, -1)
        known = known.replaced(_by_bucket(*(columns[i][order] for i in (0, 1, 3)), self.bucket_us, new >= 0))
        yield from self._answers(fresh, names, *(columns[i][order] for i in (0, 1, 3)), new, known.of(known.code < asked), older.spread(asked), seen)

        before_us = int(known.last_us.max()) - self.keep_us
        # buckets that have ended are merged at once, never written: each write is a call to the state store
        live = [b for b in np.unique(bucket).tolist() if not self._ended(b, before_us)]
        if live:
            self._write(live, names, known, fresh, bucket, read)
        self._expire(names, older, timer, known, before_us, stored)

    def _state(self, keys: pa.Array) -> tuple[pa.Array, _Moments, int | None, _Moments]:
        """The names of ``keys`` and of all keys of the state, the moments of the time before, the timer, and the moments of the buckets."""
        _, packed, timer = tuple(self.older.get()) if self.older.exists() else (0, None, None)
        parts = [_unpack(packed, _MOMENTS)] if packed is not None else []
        buckets = {k[0]: _unpack(v[0], _MOMENTS) for k, v in self.moments.iterator()}
        names = pa.concat_arrays([keys, *[b.column("key") for b in [*parts, *buckets.values()]]]).dictionary_encode().dictionary
        known = _joined(list(buckets.values()), _MOMENTS)
        number = np.repeat(np.array(list(buckets), dtype=np.int64), [len(b) for b in buckets.values()])
        return names, _Moments.read(_joined(parts, _MOMENTS), names), timer, _Moments.read(known, names, number)

    def _write(self, live: list[int], names: pa.Array, known: _Moments, fresh: pa.RecordBatch, bucket: np.ndarray, read: Mapping[int, pa.RecordBatch]) -> None:
        sorted_known = known.of(np.argsort(known.bucket, kind="stable"))
        place = np.argsort(bucket, kind="stable")
        ids = pc.fill_null(fresh.column("id"), "")
        added = pa.RecordBatch.from_arrays([*(fresh.column(n) for n in ("key", "us", "seq", "amount")), ids], schema=_STORED).take(pa.array(place))
        bounds = [np.searchsorted(x, live, side=side).tolist() for x in (sorted_known.bucket, bucket[place]) for side in ("left", "right")]
        for b, m_lo, m_hi, lo, hi in zip(live, *bounds):
            rows = added.slice(lo, hi - lo)
            self.moments.updateValue((b,), (sorted_known.of(slice(m_lo, m_hi)).packed(names),))
            self.rows.updateValue((b,), ((_joined([read[b], rows], _STORED) if b in read else rows).serialize().to_pybytes(),))

    def _ended(self, bucket, before_us: int):
        return (bucket + 1) * self.bucket_us <= before_us

    def _answers(self, fresh: pa.RecordBatch, names: pa.Array, code: np.ndarray, us: np.ndarray, amount: np.ndarray, new: np.ndarray, known: _Moments, older: _Moments, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Batches of rows with their history, so many whole keys at once that their rows and the span of time fit."""
        asked = len(older.n)
        ends = np.searchsorted(code, np.arange(asked), side="right")
        span = int(us.max()) // self.bucket_us - int(us.min() - max(self.windows.values())) // self.bucket_us + 2
        most = max(1, (1 << 62) // (span * self.bucket_us))
        k = 0
        while k < asked:
            first = int(ends[k - 1]) if k else 0
            upto = min(max(k + 1, int(np.searchsorted(ends, first + ANSWER_ROWS, side="right"))), k + most, asked)
            rows, of = slice(first, int(ends[upto - 1])), slice(*np.searchsorted(known.code, [k, upto]).tolist())
            at = np.flatnonzero(new[rows] >= 0)
            columns = self._as_of(code[rows] - k, us[rows], amount[rows], at, known.of(of).moved(-k), older.of(slice(k, upto)))
            place = pa.array(new[rows][at])
            of_key, when = pa.array(code[rows][at] - k), us[rows][at]
            own = [n.split(":", 1) for n in names.slice(k, upto - k).to_pylist()]
            answer = pa.RecordBatch.from_arrays([
                *(pa.array([n[i] for n in own], pa.string()).take(of_key) for i in (0, 1)), fresh.column("id").take(place), pa.array(when), fresh.column("seq").take(place),
                fresh.column("amount").take(place), *columns, pa.array(when < seen[code[rows][at]]), fresh.column("payload").take(place),
            ], schema=_ANSWER)
            yield from (answer.slice(i, PACK_ROWS) for i in range(0, len(answer), PACK_ROWS))
            k = upto

    def _as_of(self, code: np.ndarray, us: np.ndarray, amount: np.ndarray, at: np.ndarray, known: _Moments, older: _Moments) -> list[pa.Array]:
        """History columns of the rows at places ``at``; keys are numbers from 0 on, rows and buckets lie in the order of key and time."""
        n_keys, bucket = len(older.n), us // self.bucket_us
        own_rows, own_buckets = np.bincount(code, minlength=n_keys), np.bincount(known.code, minlength=n_keys)
        row_0, bucket_0 = np.cumsum(own_rows) - own_rows, np.cumsum(own_buckets) - own_buckets
        n, total, mean, m2 = known.n, known.total.astype(_WIDE), known.mean.astype(_WIDE), known.m2.astype(_WIDE)
        with np.errstate(invalid="ignore", over="ignore"):
            centre = (np.add.reduceat(total, bucket_0) + older.total) / np.maximum(1, np.add.reduceat(n, bucket_0) + older.n)
            off, older_off = mean - centre[known.code], older.mean.astype(_WIDE) - centre
            n_upto = np.cumsum(n) - n
            sum_upto, dev_upto, square_upto = _before([total, n * off, m2 + n * off**2], bucket_0, own_buckets)
            wide = amount.astype(_WIDE)
            row_off = wide - centre[code]
            row_sum, row_dev, row_square = _before([wide, row_off, row_off**2], row_0, own_rows)

            # a key and a time, or a key and a bucket, as one number
            low = (int(us.min()) - max(self.windows.values())) // self.bucket_us
            span = int(us.max()) // self.bucket_us - low + 2
            joint_us, joint_row = code * (span * self.bucket_us) + (us - low * self.bucket_us), code * span + (bucket - low)
            joint_bucket = known.code * span + np.clip(known.bucket - low, -1, span - 1)  # buckets before and after all loaded rows stay beside their key
            key, when, own_bucket = code[at], us[at], bucket[at]
            own = np.searchsorted(joint_bucket, key * span + (own_bucket - low))  # the row's bucket among all buckets
            begin = np.searchsorted(joint_row, key * span + (own_bucket - low))  # and its first row among the loaded rows
            n_prior = older.n[key] + n_upto[own] - n_upto[bucket_0[key]] + at - begin
            sum_prior = older.total[key] + sum_upto[own] + row_sum[at] - row_sum[begin]
            dev = older.n[key] * older_off[key] + dev_upto[own] + row_dev[at] - row_dev[begin]
            square = older.m2[key] + older.n[key] * older_off[key] ** 2 + square_upto[own] + row_square[at] - row_square[begin]
            some = np.maximum(n_prior, 1)
            variance = np.maximum(square - dev**2 / some, 0) / np.maximum(n_prior - 1, 1)
            before = np.where(own > bucket_0[key], known.last_us[np.maximum(own - 1, 0)], older.last_us[key])
            previous = np.where(at > begin, us[np.maximum(at - 1, 0)], before)
            out = [pa.array(n_prior), pa.array(np.where(n_prior > 0, sum_prior / some, 0).astype(np.float64)),
                   pa.array(np.where(n_prior > 1, np.sqrt(variance), 0).astype(np.float64)), pa.array(previous, mask=n_prior == 0)]
            for width in self.windows.values():
                since = when - width
                edge = since // self.bucket_us
                first = np.searchsorted(joint_us, key * (span * self.bucket_us) + (since - low * self.bucket_us))
                # the edge's rows up to its end, then whole buckets, then the row's own up to it; or rows of one bucket
                one = edge == own_bucket
                end = np.where(one, begin, np.searchsorted(joint_row, key * span + (edge - low), side="right"))
                after = np.where(one, own, np.searchsorted(joint_bucket, key * span + (edge - low), side="right"))
                n_edge, s_edge = np.maximum(end - first, 0), np.where(end > first, row_sum[end] - row_sum[np.minimum(first, end)], 0)
                count = np.where(one, at - first, n_edge + n_upto[own] - n_upto[after] + at - begin)
                value = np.where(one, row_sum[at] - row_sum[first], s_edge + sum_upto[own] - sum_upto[after] + row_sum[at] - row_sum[begin])
                out += [pa.array(count), pa.array(np.where(count > 0, value, 0).astype(np.float64))]
        return out

    def _expire(self, names: pa.Array, older: _Moments, timer: int | None, known: _Moments, before_us: int | None, stored: set[int]) -> None:
        """Merge buckets that end before ``before_us`` (all, if None) into the older moments; those not ``stored`` were never written."""
        gone = np.full(len(known.n), True) if before_us is None else self._ended(known.bucket, before_us)
        for b in np.unique(known.bucket[gone]).tolist():
            if b in stored:
                self.moments.removeKey((b,))
                self.rows.removeKey((b,))
        left, stood = known.last_us[~gone], timer
        if len(left) and timer is None:
            timer = (int(left.max()) + self.keep_us) // 1000
            self.handle.registerTimer(timer)
        if gone.any():
            older = older.merged(known.of(gone))
        if gone.any() or timer != stood:
            self.older.update((int(older.n.sum()), older.packed(names), timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names, older, _, known = self._state(pa.array([], pa.string()))
        newest = int(known.last_us.max(initial=0))
        quiet = newest + self.keep_us <= expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999
        self.older.update((int(older.n.sum()), older.packed(names), None))
        self._expire(names, older, None, known, None if quiet else newest - self.keep_us, set(known.bucket.tolist()))
        return iter(())

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """ST6: the rows of ``entity_state.bucketed`` of one bucket a call, or (without a number) everything before the first."""
        s = initialState
        found = pa.RecordBatch.from_pylist([{f: k[f] for f in _MOMENTS.names} for k in s.found], schema=_MOMENTS)
        if s.bucket is None:
            self.older.update((sum(k["n"] for k in s.found), found.serialize().to_pybytes(), None))
            return
        rows = [{"key": k["key"], **{f: r[f] for f in ("us", "seq", "amount", "id")}} for k in s.found for r in k["rows"]]
        self.moments.updateValue((s.bucket,), (found.serialize().to_pybytes(),))
        self.rows.updateValue((s.bucket,), (pa.RecordBatch.from_pylist(rows, schema=_STORED).serialize().to_pybytes(),))

    def close(self) -> None:
        pass


class CellHistory(EntityHistory):
    """Rows of all keys of a cell, packed."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for answer in self._answered(_joined([_unpack(r.packed, _FRESH) for r in rows], _FRESH)):
            yield _PACKED(answer.serialize().to_pybytes())


class _Moments:
    """Count, sum, mean, squared deviation and last time of sets of rows: of a key (by its number), or of a key in a bucket."""

    FIELDS = ("n", "total", "mean", "m2", "last_us")

    def __init__(self, code: np.ndarray, bucket: np.ndarray | None, *values: np.ndarray) -> None:
        self.code, self.bucket = code, bucket
        self.n, self.total, self.mean, self.m2, self.last_us = values

    @classmethod
    def read(cls, batch: pa.RecordBatch, names: pa.Array, bucket: np.ndarray | None = None) -> _Moments:
        return cls(_codes(batch.column("key"), names), bucket, *_numbers(batch, *cls.FIELDS))

    def _values(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in self.FIELDS]

    def of(self, places) -> _Moments:
        return _Moments(self.code[places], None if self.bucket is None else self.bucket[places], *[v[places] for v in self._values()])

    def moved(self, by: int) -> _Moments:
        return _Moments(self.code + by, self.bucket, *self._values())

    def packed(self, names: pa.Array) -> bytes:
        return _pack(_MOMENTS, [names.take(pa.array(self.code)), *self._values()])

    def spread(self, n_keys: int) -> _Moments:
        """One set a key, from number 0 on; empty ones for keys that have none."""
        out, some = [np.zeros(n_keys, v.dtype) for v in self._values()], self.code < n_keys
        for o, v in zip(out, self._values()):
            o[self.code[some]] = v[some]
        return _Moments(np.arange(n_keys), None, *out)

    def replaced(self, by: _Moments) -> _Moments:
        """With the sets ``by`` in place of those of the same key and bucket, in the order of key and bucket."""
        numbers = np.unique(np.concatenate([self.bucket, by.bucket]))
        joint = [m.code * len(numbers) + np.searchsorted(numbers, m.bucket) for m in (self, by)]
        kept = self.of(~np.isin(joint[0], joint[1]))
        both = _Moments(*[np.concatenate([a, b]) for a, b in zip((kept.code, kept.bucket, *kept._values()), (by.code, by.bucket, *by._values()))])
        return both.of(np.lexsort((both.bucket, both.code)))

    def merged(self, more: _Moments) -> _Moments:
        """All sets of a key as one."""
        code = np.concatenate([self.code, more.code])
        order = np.argsort(code, kind="stable")
        n, total, mean, m2, last = (np.concatenate([a, b])[order] for a, b in zip(self._values(), more._values()))
        code, first = np.unique(code[order], return_index=True)
        with np.errstate(invalid="ignore", over="ignore"):
            count, wide = np.add.reduceat(n, first), mean.astype(_WIDE)
            centre = np.add.reduceat(n * wide, first) / count
            spread = np.add.reduceat(m2 + n * (wide - np.repeat(centre, np.diff(first, append=len(n)))) ** 2, first)
        return _Moments(code, None, count, np.add.reduceat(total.astype(_WIDE), first).astype(np.float64), centre.astype(np.float64), spread.astype(np.float64), np.maximum.reduceat(last, first))


def _in_order(code: np.ndarray, us: np.ndarray, seq: np.ndarray, ids: pa.Array) -> np.ndarray:
    """Places of the rows by key, time, sequence number and id; ids are looked at where all else is equal."""
    order = np.lexsort((seq, us, code))
    equal = np.logical_and.reduce([x[order[1:]] == x[order[:-1]] for x in (code, us, seq)])
    if equal.any():
        at = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))
        some = order[at]
        text = np.array(pc.fill_null(ids.take(pa.array(some)), "").to_pylist())
        order[at] = some[np.lexsort((text, seq[some], us[some], code[some]))]
    return order


def _by_bucket(code: np.ndarray, us: np.ndarray, amount: np.ndarray, bucket_us: int, new: np.ndarray) -> _Moments:
    """Moments of each key's buckets that have a ``new`` row, from ordered rows."""
    bucket, wide = us // bucket_us, amount.astype(_WIDE)
    first = np.flatnonzero(np.insert((code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]), 0, True))
    n = np.diff(first, append=len(us))
    with np.errstate(invalid="ignore", over="ignore"):
        total = np.add.reduceat(wide, first)
        mean = total / n
        m2 = np.add.reduceat((wide - np.repeat(mean, n)) ** 2, first)
    some = np.logical_or.reduceat(new, first)
    values = (n, total.astype(np.float64), mean.astype(np.float64), m2.astype(np.float64), us[first + n - 1])
    return _Moments(code[first].astype(np.int64), bucket[first], *values).of(some)


def _before(columns: list[np.ndarray], first: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Running totals of the values before each one, from its key's first on. Keys of about one length are added up side by side, so no key rounds by another's values."""
    out = [np.zeros(len(c), _WIDE) for c in columns]
    size = np.frexp(count)[1]
    for s in np.unique(size[count > 1]).tolist():
        keys = np.flatnonzero(size == s)
        inside = np.arange(int(count[keys].max()) - 1) < (count[keys] - 1)[:, None]
        at = (first[keys][:, None] + np.arange(inside.shape[1]))[inside]
        for column, total in zip(columns, out):
            side = np.zeros(inside.shape, _WIDE)
            side[inside] = column[at]
            total[at + 1] = np.cumsum(side, axis=1)[inside]
    return out


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of transactions as rows of entities, those of a cell packed into one value."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= PACK_ROWS:
            yield _packed_cells(held)
            held, n = [], 0
    if n:
        yield _packed_cells(held)


def _packed_cells(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    txns = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    keys, cells, places, carriers, free = [], [], [], [], np.full(len(txns), True)
    for i in range(len(ENTITIES) + 1):
        given = txns.column(f"key_{i}").is_valid().to_numpy(zero_copy_only=False)
        places.append(np.flatnonzero(given))
        keys.append(txns.column(f"key_{i}").drop_null())
        cells.append(txns.column(f"cell_{i}").to_numpy(zero_copy_only=False)[given].astype(np.int32))
        carriers.append(free[given])
        free &= ~given
    cell, place, carrier = (np.concatenate(x) for x in (cells, places, carriers))
    order = np.argsort(cell, kind="stable")
    cell, place, carrier = cell[order], place[order], carrier[order]
    at = pa.array(place)
    rows = pa.RecordBatch.from_arrays([pa.concat_arrays(keys).take(pa.array(order)), *(txns.column(c).take(at) for c in ("us", "seq", "amount", "id")),
                                       txns.column("payload").take(pa.array(place, mask=~carrier))], schema=_FRESH)
    number, first = np.unique(cell, return_index=True)
    packed = [rows.slice(lo, n).serialize().to_pybytes() for lo, n in zip(first.tolist(), np.diff(first, append=len(cell)).tolist())]
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(packed, pa.binary())], names=["cell", "packed"])


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for packed in batch.column("packed"):
            held.append(pa.ipc.read_record_batch(packed.as_buffer(), _ANSWER))
            n += len(held[-1])
            if n >= PACK_ROWS:
                yield _joined(held, _ANSWER)
                held, n = [], 0
    if n:
        yield _joined(held, _ANSWER)


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int")


def stream_history(transactions: DataFrame, lateness: str = "1 hour", payload: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """History columns of every (transaction, entity) on a stream of transactions.

    Deliveries repeat (at-least-once sources), so ids are dropped once seen within the
    watermark. ``payload`` names a text column to carry along once per transaction;
    ``initial`` is a batch snapshot (``entity_state.bucketed``) the state starts from. A
    transaction without any key has one row, of the entity ''.
    """
    text = F.col(payload) if payload else F.lit(None).cast("string")
    marked = (
        transactions.withColumn("_text", text)
        .withWatermark("event_timestamp", lateness)
        .dropDuplicatesWithinWatermark(["transaction_id"])
    )
    keyless = F.coalesce(*[F.col(c).cast("string") for c in ENTITIES.values()]).isNull()
    keys = [F.concat(F.lit(f"{e}:"), F.col(c).cast("string")) for e, c in ENTITIES.items()]
    keys.append(F.when(keyless, F.concat(F.lit(":"), F.coalesce(F.col("transaction_id"), F.lit("")))))
    rows = marked.select(
        F.unix_micros("event_timestamp").alias("us"),
        F.coalesce(F.col("transaction_sequence_id"), F.lit(0)).cast("bigint").alias("seq"),
        F.coalesce(F.col("amount"), F.lit(0.0)).cast("double").alias("amount"),
        F.col("transaction_id").alias("id"),
        F.col("_text").alias("payload"),
        *[c for i, k in enumerate(keys) for c in (k.alias(f"key_{i}"), _cell(k).alias(f"cell_{i}"))],
    )
    if initial is not None:
        key = F.concat("entity", F.lit(":"), "entity_id")
        found = F.collect_list(F.struct("key", "n", "total", "mean", "m2", "last_us", "rows")).alias("found")
        initial = initial.withColumn("key", key).withColumn("cell", _cell(key)).groupBy("cell", "bucket").agg(found).groupBy("cell")
    # keys of a cell share a clock: a bucket is kept until no row that the watermark lets in can reach it
    lateness_us = transactions.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {lateness})")).first()[0]
    answers = rows.mapInArrow(_pack_rows, "cell int, packed binary").groupBy("cell").transformWithState(
        statefulProcessor=CellHistory(lateness_us=max(LATENESS_US, lateness_us)),
        outputStructType=T.StructType([T.StructField("packed", T.BinaryType())]),
        outputMode="Append",
        timeMode="EventTime",
        initialState=initial,
    )
    return answers.mapInArrow(_unpack_rows, OUTPUT)


LIVE = T.StructType([
    T.StructField("entity", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    # All values the entity has now; empty when the last has expired.
    T.StructField("features", T.MapType(T.StringType(), T.StringType())),
])
_LIVE_ROW = Row(*LIVE.fieldNames())


class LiveValues(StatefulProcessor):
    """ST3: the newest value of each feature of an entity, which expires ``ttl_us`` after its last update.

    One event-time timer a key stands at the first time a value may expire; it removes what has expired, and moves on to the next.
    """

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "feature string", "value string, us bigint, seq bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, _ = self._live(timerValues.getCurrentWatermarkInMs())
        changed = set()
        for r in rows:
            if r.feature not in known or (r.us, r.seq) > known[r.feature][1:]:
                known[r.feature] = (r.value, r.us, r.seq)
                changed.add(r.feature)
        for feature in changed:
            self.values.updateValue((feature,), known[feature])
        # a timer that stands is no later than the first expiry: an accepted row's is after the watermark, and values are only renewed
        if not self.timer.exists():
            self._stand(known)
        yield self._row(key, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all that has expired by the watermark: a timer set in the past would wait for the next micro-batch
        known, gone = self._live(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        self.timer.clear()
        if known:
            self._stand(known)
        if gone:
            yield self._row(key, known)

    def close(self) -> None:
        pass

    def _live(self, now_ms: int) -> tuple[dict[str, tuple], list[str]]:
        """The values that have not expired, and the names of those that have, which are removed."""
        known = {k[0]: tuple(v) for k, v in self.values.iterator()}
        gone = [f for f, v in known.items() if self._expiry(v) <= now_ms]
        for feature in gone:
            del known[feature]
            self.values.removeKey((feature,))
        return known, gone

    def _expiry(self, value: tuple) -> int:
        return -(-(value[1] + self.ttl_us) // 1000)

    def _stand(self, known: Mapping[str, tuple]) -> None:
        at = min(map(self._expiry, known.values()))
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _row(self, key, known: Mapping[str, tuple]) -> Row:
        return _LIVE_ROW(key[0], key[1], {f: v[0] for f, v in known.items()})


def live_values(updates: DataFrame, ttl_us: int, lateness: str = "1 hour") -> DataFrame:
    """ST3, ST4 on a stream (update mode): an entity's features whenever one is written or expires, from updates ``entity, entity_id, us, seq, feature, value``.

    The last row of each entity equals ``latest_values`` with the same ``ttl_us`` over all updates, as of the watermark. State holds the values
    written in the last ``ttl_us`` and lateness only. A late update cannot replace a newer one.
    """
    timed = updates.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", lateness)
    return timed.groupBy("entity", "entity_id").transformWithState(statefulProcessor=LiveValues(ttl_us), outputStructType=LIVE, outputMode="Update", timeMode="EventTime")
