"""What keeps tasks and the driver small: rows that are not sent whole, tasks by rows, windows whose cost does not grow with their rows."""

import datetime as dt
import math
import random
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.functions import report, spread
from riskflow.operators import entity_state as ES
from riskflow.operators import velocity as V
from riskflow.session import COMPILED_BYTES, prepare
from riskflow.streaming import state
from riskflow.streaming.state import EntityHistory
from tests.conftest import SMALL

START = dt.datetime(2026, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["parity_check", "parity_defects", "velocity_windows_hot_keys"])
def test_no_side_is_sent_whole_for_the_size_of_its_file(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, SMALL))


def test_windows_grow_from_the_first_row(txns):
    df = V.velocity(txns([{}]), ENTITIES, WINDOWS_US, strategy="windows")
    assert "specifiedwindowframe(RangeFrame, -" not in plan(df)


def test_key_of_many_rows_takes_no_probes(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("running totals for a key that fits a task")

    monkeypatch.setattr(V, "_by_totals", refused)
    rows = spark.range(20_001).select(
        F.lit("merchant").alias("entity"), F.lit("M").alias("entity_id"), F.col("id").cast("string").alias("transaction_id"),
        (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("seq"), F.lit(1.0).alias("amount"))
    last = V.entity_history(rows, WINDOWS_US).where("seq = 20000").first()
    assert (last.n_prior, last.n_5m, last.sum_1h, last.n_7d) == (20_000, 300, 3600.0, 20_000)


def test_sums_of_far_apart_and_odd_amounts(txns):
    amounts = [1e15, 0.01, float("nan"), 0.02, float("inf"), -0.5, float("-inf"), 0.1, 0.2, 0.3]
    df = txns([{"event_timestamp": START + dt.timedelta(hours=2 * i), "amount": a} for i, a in enumerate(amounts)])
    rows = V.velocity(df, {"customer": "customer_id"}, WINDOWS_US, strategy="windows").orderBy("transaction_id").collect()
    for w, hours in (("1h", 1), ("6h", 6), ("24h", 24)):
        for i, r in enumerate(rows):
            want = sum(amounts[j] for j in range(i) if 2 * (i - j) <= hours)
            got = r[f"customer_amount_sum_{w}"]
            assert (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-14), (w, i)


def test_one_row_a_key_and_one_more_without_any(txns):
    rows = V.entity_rows(txns([{}, {"customer_id": None}]), {"customer": "customer_id"}, keyless=True)
    assert sorted((r.entity, r.entity_id) for r in rows.collect()) == [("", "T00001"), ("customer", "C1")]


def test_tasks_follow_the_rows(txns, monkeypatch):
    monkeypatch.setattr(spread, "TASK_ROWS", 10)
    df = txns([{} for _ in range(12)])
    assert spread.tasks(df, 95) == 10 and spread.tasks(df, 1) == df.sparkSession.sparkContext.defaultParallelism
    assert ES.transaction_updates(df, {"a": F.lit(1), "b": F.lit(2)}).rdd.getNumPartitions() == 15  # 12 rows, 6 entities, 2 features
    assert V.velocity(df, windows=None).rdd.getNumPartitions() == 8  # 72 rows
    state = ES.snapshot(df)
    assert ES.transaction_context(df, state, ["txn_count"]).rdd.getNumPartitions() == 9  # 84 rows with the anchors
    assert "Broadcast" not in plan(ES.transaction_context(df, state, ["txn_count"]))


@pytest.mark.parametrize(("cells", "limit", "counts", "probes"), [(1 << 16, 100, 1, False), (1, 100, 2, False), (1 << 16, 9, 2, True)])
def test_keys_are_counted_only_where_a_cell_is_large(spark, monkeypatch, cells, limit, counts, probes):
    calls, real = [], V._most
    monkeypatch.setattr(V, "_SIZE_CELLS", cells)
    monkeypatch.setattr(V, "_most", lambda *a: calls.append(a) or real(*a))
    rows = spark.range(200).select(
        F.lit("card").alias("entity"), F.when(F.col("id") < 20, "hot").otherwise(F.col("id").cast("string")).alias("entity_id"), F.col("id").cast("string").alias("transaction_id"),
        (F.col("id") * 1_000_000).alias("us"), F.col("id").alias("seq"), F.lit(1.0).alias("amount"))
    got = V.entity_history(rows, WINDOWS_US, limit=limit)
    assert len(calls) == counts and ("explode(" in got._jdf.queryExecution().analyzed().toString()) == probes
    assert {r.seq: r.n_prior for r in got.collect()} == {i: i if i < 20 else 0 for i in range(200)}


@pytest.mark.parametrize("digits", [0, 1, 3, 6])
def test_rounding_without_decimal_text_gives_the_same(spark, digits):
    at = 10.0**-digits
    odd = [None, float("nan"), float("inf"), float("-inf"), -0.0, -0.4 * at, 0.5 * at - report.guard(digits), -0.5 * at - report.guard(digits), 1e300, -3e15, 2.0**40 * at]
    rows = spark.createDataFrame([(v,) for v in [*odd, *[(i - 500) * 1.2345678 * at for i in range(1000)]]], "v double")
    moved = F.col("v") + F.lit(report.guard(digits))
    clear = rows.select(report.rounded("v", digits).alias("got"), F.round(moved, digits).alias("want"))
    assert "floor" in plan(clear).lower()
    assert clear.where("not (got <=> want) or string(got) <> string(want)").count() == 0


def test_long_methods_are_not_left_to_the_interpreter(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for given, want in ((65535, COMPILED_BYTES), (4000, 4000)):
            spark.conf.set(limit, str(given))
            assert prepare(spark).conf.get(limit) == str(want)
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("limit", [3, 1000])
def test_context_by_keys_and_by_cells_agree(txns, limit):
    df = txns([{"customer_id": f"C{i % 2}", "amount": 100.0 + i, "event_timestamp": START + dt.timedelta(minutes=7 * (i // 2)), "device_id": None} for i in range(16)])
    versions = V.entity_rows(df.where("transaction_sequence_id % 3 = 0")).groupBy("entity", "entity_id", "us").agg(F.max("seq").alias("seq"), F.max("amount").alias("value"))
    known = versions.collect()
    got = ES.context_as_of(df, versions, ["value"], limit=limit)
    assert ("Join" in plan(got)) == (limit == 3)
    rows = got.collect()
    assert len(rows) == 16
    for r in rows:
        past = [(v.us, v.value) for v in known if v.entity == "customer" and v.entity_id == f"C{r.seq % 2}" and v.us <= r.us]
        assert r.customer_value == (max(past)[1] if past else None) and r.device_value is None


class _Handle:
    """A state store that counts its writes and removals."""

    def __init__(self):
        self.calls, self.value, self.maps, self.timers = 0, None, {}, []

    def getValueState(self, name, schema):
        outer = self

        class State:
            def exists(self):
                return outer.value is not None

            def get(self):
                return outer.value

            def update(self, v):
                outer.value = v

        return State()

    def getMapState(self, name, key, schema):
        outer, data = self, self.maps.setdefault(name, {})

        class State:
            def iterator(self):
                return iter(list(data.items()))

            def getValue(self, k):
                return data[k]

            def updateValue(self, k, v):
                outer.calls += 1
                data[k] = v

            def removeKey(self, k):
                outer.calls += 1
                del data[k]

        return State()

    def registerTimer(self, at):
        self.timers.append(at)


def test_buckets_that_no_window_reaches_are_never_written(txns):
    hour = 3_600_000_000
    processor, handle = EntityHistory(), _Handle()
    processor.init(handle)

    class R:
        def __init__(self, h):
            self.us, self.seq, self.transaction_id, self.amount, self.payload = h * hour, h, f"T{h}", 1.0, None
    first = list(processor.handleInputRows(("card", "K"), iter([R(h) for h in range(30 * 24)]), None))
    assert [r.n_prior for r in first] == list(range(720)) and first[-1].n_7d == 168 and first[-1].sum_7d == 168.0
    # the last seven days, the lateness and the newest row's bucket
    assert sorted(k[0] for k in handle.maps["rows"]) == list(range(550, 720))
    assert handle.calls == 2 * 170 and handle.value[0] == 550
    (later,) = processor.handleInputRows(("card", "K"), iter([R(800)]), None)
    assert (later.n_prior, later.n_7d) == (720, 168 - 81 + 1) and min(k[0] for k in handle.maps["rows"]) == 631


def test_keys_of_a_cell_are_answered_and_written_together():
    """Four deliveries for 60 keys, the third of them late: each row as a walk over its own key's rows says, and no more calls to the state store than buckets need."""
    hour, draw = 3_600_000_000, random.Random(5)
    processor, handle = state.CellHistory(lateness_us=12 * 3_600_000_000), _Handle()
    processor.init(handle)
    start = 19_000 * 24 * hour
    span = {0: (0, 9 * 24), 1: (9 * 24, 12 * 24), 2: (12 * 24 - 12, 12 * 24 - 6), 3: (12 * 24, 12 * 24 + 5)}
    deliveries = [[(f"card:K{draw.randrange(60)}", start + draw.randrange(lo * 4, hi * 4) * hour // 4, draw.randrange(3), draw.choice([0.01, 3.5, 250.25]), f"T{d}{i}") for i in range(2000)]
                  for d, (lo, hi) in span.items()]
    odd, large = "card:K7", "card:K3"  # no other key feels that their values are no numbers, or huge
    deliveries = [[(k, us, seq, float("nan") if k == odd else a * 1e9 if k == large else a, i) for k, us, seq, a, i in rows] for rows in deliveries]
    came = []
    for d, rows in enumerate(deliveries):
        columns = [*map(list, zip(*rows)), [None] * len(rows)]
        packed = [state._pack(state._FRESH, [pa.array(c[i::3], f.type) for c, f in zip(columns, state._FRESH)]) for i in range(3)]
        calls = handle.calls
        answers = [state._unpack(a.packed, state._ANSWER).to_pylist() for a in processor.handleInputRows((1,), iter([Row(packed=p) for p in packed]), None)]
        if d == 0:
            live = {us // hour for _, us, *_ in rows if (us // hour + 1) * hour > max(r[1] for r in rows) - 180 * hour}
            assert handle.calls - calls == 2 * len(live) and {k[0] for k in handle.maps["rows"]} == live
        newest = {k: max(r[1] for r in came if r[0] == k) for k in {r[0] for r in came}}
        came += rows
        got = {r["transaction_id"]: r for batch in answers for r in batch}
        assert len(got) == len(rows)
        for key, us, seq, amount, name in rows:
            r = got[name]
            past = sorted((o[1:] for o in came if o[0] == key and (o[1], o[2], o[4]) < (us, seq, name)), key=lambda o: (o[0], o[1], o[3]))
            assert (r["entity"], r["entity_id"], r["us"], r["seq"]) == ("card", key[5:], us, seq)
            assert (r["n_prior"], r["prev_us"], r["out_of_order"]) == (len(past), past[-1][0] if past else None, us < newest.get(key, us))
            for w, width in WINDOWS_US.items():
                inside = [o[2] for o in past if o[0] >= us - width]
                assert r[f"n_{w}"] == len(inside)
                if key != odd:
                    assert r[f"sum_{w}"] == pytest.approx(math.fsum(inside), rel=1e-12, abs=1e-6)
            if key != odd and len(past) > 1:
                amounts = [o[2] for o in past]
                assert r["avg_prior"] == pytest.approx(math.fsum(amounts) / len(amounts), rel=1e-12)
                assert r["std_prior"] == pytest.approx(statistics.stdev(amounts), rel=1e-9, abs=1e-6)
    assert handle.value[0] + sum(len(state._unpack(v[0], state._STORED)) for v in handle.maps["rows"].values()) == 8000
