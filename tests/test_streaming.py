import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from riskflow.config import WINDOWS_US
from riskflow.operators import encode, entity_state, monitoring, training, velocity
from riskflow.operators.decisions import decide
from riskflow.operators.leakage import strip_labels
from riskflow.plans.features import ENGINEERED, feature_table
from riskflow.plans.scoring import Scorer
from riskflow.sources.fixture import scored, transactions
from riskflow.sources.kafka import messages, read_folder, route
from riskflow.sources.sinks import append_audit, audit_rows, label_free_feed
from riskflow.streaming import ingest, jobs
from riskflow.streaming.state import live_values, stream_history
from tests.conftest import SMALL


def feed_files(df, folder, parts):
    """One JSON file per time slice, in time order."""
    n = df.count()
    for i in range(parts):
        piece = df.where(F.floor(F.col("transaction_sequence_id") * parts / n) == i)
        label_free_feed(piece).repartition(1).write.mode("append").json(folder)
        time.sleep(1.05)  # the file source orders files by their second of change


@pytest.fixture(scope="module")
def table(spark):
    return transactions(spark, SMALL).cache()


@pytest.mark.parametrize(
    "text, error",
    [
        ("{oops", "malformed_json"),
        ("[1]", "malformed_json"),
        (None, "malformed_json"),
        ('{"transaction_id":"x","zzz":1}', "unknown_field: zzz"),
        ('{"transaction_id":"x","fraud_scenario":"A"}', "forbidden_field: fraud_scenario"),
        ('{"transaction_id":"x"}', "missing_field: account_id,amount,card_id,customer_id,device_id,event_timestamp,ip_id,merchant_id"),
    ],
)
def test_first_broken_rule_is_named(spark, text, error):
    df = spark.createDataFrame([("k", text)], "key string, value string")
    assert ingest.validate_messages(df, "request").first()["error"] == error


def test_types_defaults_and_contracts(spark, txns):
    good = messages(strip_labels(txns([{}])))
    text = good.first()["value"]
    variants = [text, text.replace('"card_age_days":0', '"card_age_days":"old"'), text.replace('"card_age_days":0', '"card_age_days":12.0'),
                text.replace('"card_age_days":0', '"card_age_days":1.5'), text.replace('"amount":100.0', '"amount":null')]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(variants)], "key string, value string")
    rows = ingest.validate_messages(df).orderBy("key").collect()
    assert [r["error"] for r in rows] == [None, "wrong_type: card_age_days", None, "wrong_type: card_age_days", "missing_field: amount"]
    assert rows[2]["card_age_days"] == 12
    labelled = messages(txns([{}]))
    assert ingest.validate_messages(labelled, "training").first()["error"] is None
    assert ingest.validate_messages(labelled).first()["error"].startswith("forbidden_field")
    sparse = spark.createDataFrame([("k", '{"transaction_id":"x","event_timestamp":"2026-01-01T00:00:00","customer_id":"c","account_id":"a","card_id":"k","merchant_id":"m","device_id":"d","ip_id":"i","amount":5}')], "key string, value string")
    row = ingest.validate_messages(sparse, "request", with_defaults=True).first()
    assert row["error"] is None and row["currency"] == "USD" and row["credit_limit"] == 5000.0


def test_messages_round_trip(table):
    sent = ingest.accepted(ingest.validate_messages(messages(strip_labels(table))))
    assert sent.exceptAll(strip_labels(table)).count() == 0 and sent.count() == table.count()


def test_feed_is_ordered_and_label_free(table):
    rows = label_free_feed(table, 50).collect()
    assert [r["key"] for r in rows] == sorted(r["key"] for r in rows) and len(rows) == 50
    assert not any("true_fraud_label" in r["value"] for r in rows)


def test_valid_and_dead_letters_once_each(spark, table, tmp_path):
    good = messages(strip_labels(table.limit(50)))
    bad = good.limit(5).withColumn("value", F.concat(F.lit("{"), F.col("value")))
    good.unionByName(bad).repartition(2).write.json(str(tmp_path / "in"))
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        jobs.validation_job(read_folder(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/validated")).count() == 50
        letters = spark.read.json(str(tmp_path / "out/dead_letter"))
        assert letters.count() == 5
    assert '"error":"malformed_json"' in letters.first()["value"]


def run_state(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def assert_same_history(got, want, n):
    cols = ["n_prior", "avg_prior", "std_prior", "prev_us", *[f"{k}_{w}" for w in WINDOWS_US for k in ("n", "sum")]]
    joined = got.alias("a").join(want.alias("b"), ["transaction_id", "entity", "entity_id"])
    assert got.count() == want.count() == joined.count() == n
    worst = joined.agg(*[F.max(F.abs(F.coalesce(F.col(f"a.{c}"), F.lit(-1)) - F.coalesce(F.col(f"b.{c}"), F.lit(-1)))).alias(c) for c in cols]).first().asDict()
    assert max(worst.values()) < 1e-6, worst


def test_state_equals_batch_across_restart_and_duplicates(spark, table, tmp_path):
    part = table.where("transaction_sequence_id < 300")
    src = str(tmp_path / "in")
    stream = lambda: stream_history(ingest.accepted(ingest.validate_messages(read_folder(spark, src, 1))))
    feed_files(part.where("transaction_sequence_id < 150"), src, 2)
    run_state(stream(), tmp_path)
    # The last delivery of the first run comes again, shuffled, together with new rows.
    again = part.where("transaction_sequence_id BETWEEN 149 AND 299").orderBy(F.rand(3))
    messages(strip_labels(again)).coalesce(1).write.mode("append").json(src)
    run_state(stream(), tmp_path)
    want = velocity.entity_history(velocity.entity_rows(part), WINDOWS_US, strategy="windows")
    assert_same_history(spark.read.parquet(str(tmp_path / "rows")), want, 300 * 6)


def test_late_rows_are_counted(spark, table, tmp_path):
    src = str(tmp_path / "in")
    for piece in ("transaction_sequence_id BETWEEN 500 AND 519", "transaction_sequence_id BETWEEN 520 AND 539", "transaction_sequence_id < 5"):
        messages(strip_labels(table.where(piece))).coalesce(1).write.mode("append").json(src)
        time.sleep(1.05)
    stream = stream_history(ingest.accepted(ingest.validate_messages(read_folder(spark, src, 1))))
    q = run_state(stream, tmp_path)
    progress = monitoring.stream_progress(q)
    assert progress.agg(F.sum("late_rows")).first()[0] >= 5
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 40 * 6


def test_progress_of_every_batch_is_kept(spark, table, tmp_path):
    src = str(tmp_path / "in")
    for i in range(6):
        messages(strip_labels(table.where(f"transaction_sequence_id = {i}"))).coalesce(1).write.mode("append").json(src)
    log = monitoring.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        q = read_folder(spark, src, 1).writeStream.format("noop").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if (tmp_path / "progress").exists() and spark.read.parquet(log.path).where("query = 'kept'").count() >= 6:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    found = spark.read.parquet(log.path).where("query = 'kept'")
    assert found.agg(F.sum("input_rows")).first()[0] == 6 and found.select("batch_id").distinct().count() == 6


def test_initial_state_continues_history(spark, table, tmp_path):
    """A warm start equals the batch in every column, windows included."""
    src = str(tmp_path / "in")
    old, new = table.where("transaction_sequence_id < 100"), table.where("transaction_sequence_id BETWEEN 100 AND 149")
    messages(strip_labels(new)).coalesce(1).write.json(src)
    stream = stream_history(ingest.accepted(ingest.validate_messages(read_folder(spark, src))), initial=entity_state.bucketed(old, keep_us=200 * 3_600_000_000))
    run_state(stream, tmp_path)
    want = velocity.entity_history(velocity.entity_rows(old.unionByName(new)), WINDOWS_US, strategy="windows").join(new.select("transaction_id"), "transaction_id", "left_semi")
    assert_same_history(spark.read.parquet(str(tmp_path / "rows")), want, 300)


def test_time_before_the_buckets_is_one_row_a_key(spark, table):
    rows = entity_state.bucketed(table, keep_us=36 * 3_600_000_000).where("entity = 'customer'")
    whole = entity_state.snapshot(table).where("entity = 'customer'")
    assert rows.where("bucket IS NULL").count() == rows.where("bucket IS NULL").select("entity_id").distinct().count() > 0
    again = rows.groupBy("entity_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last_us").alias("last_us"))
    joined = again.join(whole, "entity_id")
    assert joined.count() == whole.count() and joined.where("n <> txn_count OR abs(total - amount_sum) > 1e-6").count() == 0


def late_feed(table, src):
    """Rows of one day; in the second delivery come some that lie between rows of the first, inside the lateness."""
    first = table.where("transaction_sequence_id < 120 AND transaction_sequence_id % 4 <> 1")
    messages(strip_labels(first)).coalesce(1).write.mode("append").json(src)
    time.sleep(1.05)
    messages(strip_labels(table.where("transaction_sequence_id < 120 AND transaction_sequence_id % 4 = 1"))).coalesce(1).write.mode("append").json(src)
    time.sleep(1.05)
    messages(strip_labels(table.where("transaction_sequence_id BETWEEN 120 AND 159"))).coalesce(1).write.mode("append").json(src)
    return first


def test_late_rows_equal_batch(spark, table, tmp_path):
    src = str(tmp_path / "in")
    first = late_feed(table, src)
    # the whole day lies inside the lateness
    run_state(stream_history(ingest.accepted(ingest.validate_messages(read_folder(spark, src, 1))), "60 days"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "rows"))
    part = table.where("transaction_sequence_id < 160")
    full = velocity.entity_history(velocity.entity_rows(part), WINDOWS_US, strategy="windows")
    late = part.where("transaction_sequence_id < 120 AND transaction_sequence_id % 4 = 1 OR transaction_sequence_id >= 120").select("transaction_id")
    assert_same_history(got.join(late, "transaction_id", "left_semi"), full.join(late, "transaction_id", "left_semi"), late.count() * 6)
    early = velocity.entity_history(velocity.entity_rows(first), WINDOWS_US, strategy="windows")
    assert_same_history(got.join(first.select("transaction_id"), "transaction_id", "left_semi"), early, first.count() * 6)
    assert got.where("prev_us > us").count() == 0 and got.where("out_of_order").count() > 0


def test_buckets_expire_and_history_goes_on(spark, txns, tmp_path):
    """Rows far apart: the state holds few buckets, and prior statistics still equal the batch."""
    start, src = dt.datetime(2026, 1, 1), str(tmp_path / "in")
    rows = strip_labels(txns([{"event_timestamp": start + dt.timedelta(days=d, hours=h), "amount": 1e9 if d == 0 else 0.01 * (d + h)} for d in range(0, 60, 3) for h in (0, 1, 30)]))
    for d in range(0, 60, 15):
        piece = rows.where(F.col("event_timestamp").between(start + dt.timedelta(days=d), start + dt.timedelta(days=d + 14, hours=23)))
        messages(piece).coalesce(1).write.mode("append").json(src)
        time.sleep(1.05)
    run_state(stream_history(ingest.accepted(ingest.validate_messages(read_folder(spark, src, 1))), "1 day"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "rows"))
    want = velocity.entity_history(velocity.entity_rows(rows), WINDOWS_US, strategy="windows")
    assert got.count() == want.count()
    cols = ["n_prior", "prev_us", "n_1h", "n_24h", "n_7d", F.round("sum_24h", 4).alias("s24"), F.round("sum_7d", 4).alias("s7")]
    small = "us >= " + str(int((start + dt.timedelta(days=9)).replace(tzinfo=dt.UTC).timestamp() * 1e6))
    assert got.where(small).select("transaction_id", "entity", *cols).exceptAll(want.where(small).select("transaction_id", "entity", *cols)).count() == 0
    buckets = spark.read.format("statestore").option("stateVarName", "moments").load(str(tmp_path / "cp"))
    assert buckets.where("user_map_value IS NOT NULL").groupBy("key").count().agg(F.max("count")).first()[0] <= 9 * 24


def test_stream_scores_equal_batch_scores(spark, table, tmp_path):
    part = table.where("transaction_sequence_id < 200")
    encoder = encode.FrequencyEncoder.fit(part)
    model = training.fit_logistic(feature_table(part, encoder, keep=["true_fraud_label"]), ENGINEERED, max_iter=10)
    scorer = Scorer(model, encoder)
    feed_files(part, str(tmp_path / "in"), 2)
    jobs.scoring_job(read_folder(spark, str(tmp_path / "in"), 1), scorer, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out/scored")), scorer.score(strip_labels(part))
    joined = got.alias("a").join(want.alias("b"), "transaction_id")
    assert got.count() == joined.count() == 200
    assert joined.where("abs(a.fraud_probability - b.fraud_probability) > 1e-9 OR a.decision <> b.decision").count() == 0
    assert spark.read.parquet(str(tmp_path / "out/audit")).count() == 200
    topics = {r["topic"]: r["count"] for r in spark.read.json(str(tmp_path / "out/topics")).groupBy("topic").count().collect()}
    assert topics["transactions.scored"] == 200 and topics.get("fraud.alerts", 0) == topics.get("fraud.blocked", 0)


def test_every_message_is_scored_late_or_dead(spark, table, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    part = table.where("transaction_sequence_id < 300")
    encoder = encode.FrequencyEncoder.fit(part)
    scorer = Scorer(training.fit_logistic(feature_table(part, encoder, keep=["true_fraud_label"]), ENGINEERED, max_iter=5), encoder)
    pieces = [messages(strip_labels(part.where(w))) for w in ("transaction_sequence_id BETWEEN 200 AND 259", "transaction_sequence_id BETWEEN 260 AND 299 OR transaction_sequence_id < 7")]
    for piece in (pieces[0], pieces[1].unionByName(pieces[1].limit(3).withColumn("value", F.lit("{broken")))):
        piece.coalesce(1).write.mode("append").json(src)
        time.sleep(1.05)
    for _ in range(2):  # the second run finds nothing new
        jobs.screening_job(read_folder(spark, src, 1), out, str(tmp_path / "cp1")).awaitTermination()
        jobs.scoring_job(jobs.read_accepted(spark, out, 1), scorer, out, str(tmp_path / "cp2")).awaitTermination()
        marks = spark.read.parquet(f"{out}/marks").orderBy("batch_id").collect()
        assert [(m.n_in, m.n_accepted, m.n_late, m.n_dead) for m in marks] == [(60, 60, 0, 0), (50, 40, 7, 3)]
        late = spark.read.parquet(f"{out}/late")
        assert late.count() == 7 and late.where("decision = 'REVIEW' AND behind_us > 3600000000").count() == 7
        assert spark.read.parquet(f"{out}/scored").count() == 100 and spark.read.json(f"{out}/dead_letter").count() == 3
        topics = {r["topic"]: r["count"] for r in spark.read.json(f"{out}/late_topics").groupBy("topic").count().collect()}
        assert topics == {"transactions.scored": 7, "fraud.review": 7}
        audit = spark.read.parquet(f"{out}/audit")
        assert audit.count() == 100 and audit.where("latency_ms > 0").count() == 100


def test_monitoring_and_gap_streams_equal_batch(spark, table, tmp_path):
    decide(scored(spark, SMALL)).write.parquet(str(tmp_path / "scored"))
    static = spark.read.parquet(str(tmp_path / "scored"))
    source = spark.readStream.schema(static.schema).parquet(str(tmp_path / "scored"))
    q = jobs.monitoring_stream(source).writeStream.format("memory").queryName("mon").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("mon").exceptAll(monitoring.decision_counts(static)).count() == 0
    strip_labels(table).write.parquet(str(tmp_path / "t"))
    rows = spark.readStream.schema(strip_labels(table).schema).parquet(str(tmp_path / "t"))
    g = jobs.gap_counter_stream(rows).writeStream.format("memory").queryName("gaps").outputMode("complete").trigger(availableNow=True).start()
    g.awaitTermination()
    batch = entity_state.gap_counters(velocity.entity_rows(table), 3_600_000_000).select("entity", "entity_id", "start_us", "end_us", "txn_count")
    assert spark.table("gaps").select(batch.columns).exceptAll(batch).count() == 0 and spark.table("gaps").count() == batch.count()


def test_a_gap_of_exactly_the_expiry_starts_a_new_counter(spark, txns, tmp_path):
    start = dt.datetime(2026, 1, 1)
    table = strip_labels(txns([{"event_timestamp": start + dt.timedelta(seconds=s)} for s in (0, 3600, 7199)]))
    table.write.parquet(str(tmp_path / "t"))
    rows = spark.readStream.schema(table.schema).parquet(str(tmp_path / "t"))
    jobs.gap_counter_stream(rows).writeStream.format("memory").queryName("edge").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    batch = entity_state.gap_counters(velocity.entity_rows(table), 3_600_000_000)
    count = lambda df: sorted(r.txn_count for r in df.where("entity = 'card'").collect())
    assert count(spark.table("edge")) == count(batch) == [1, 2]


def test_routing_and_audit_append(spark, tmp_path):
    df = decide(spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 0.9)], "transaction_id string, p double"))
    by_key = {}
    for r in route(df.select("transaction_id", "decision")).collect():
        by_key.setdefault(r["key"], set()).add(r["topic"])
    assert by_key == {"a": {"transactions.scored"}, "b": {"transactions.scored", "fraud.review"}, "c": {"transactions.scored", "fraud.blocked", "fraud.alerts"}}
    for _ in range(2):
        append_audit(audit_rows(df, "v1"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 6
    for day in ("2026-01-01", "2026-01-02"):  # a batch that is repeated after midnight
        append_audit(audit_rows(df, "v1").withColumn("scored_at", F.lit(day).cast("timestamp")), str(tmp_path / "by_batch"), 4)
    assert spark.read.parquet(str(tmp_path / "by_batch")).count() == 3


def test_values_expire_on_the_stream_as_in_the_batch(spark, tmp_path):
    """Entities that come and go for sixty days; the state holds the last day's only, and a late update replaces nothing newer."""
    hour, schema = 3_600_000_000, "entity string, entity_id string, us long, seq long, feature string, value string"
    start = 20_000 * 24 * hour
    rows = [("card", f"K{(h // 30) % 7}", start + h * hour + 5, h, f, f"{f}{h}") for h in range(0, 60 * 24, 5) for f in ("a", "b") if f == "a" or h % 3 == 0]
    late = [("card", "K0", rows[-1][2] - hour, -1, "late", "kept"), ("card", rows[-1][1], rows[-1][2] - hour, -1, "a", "too old")]
    pieces = [rows[i : i + len(rows) // 4 + 1] for i in range(0, len(rows), len(rows) // 4 + 1)] + [late]
    src, newest = str(tmp_path / "in"), {}
    for piece in pieces:
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").json(src)
        time.sleep(1.05)

    def put(batch, batch_id):
        newest.update({r.entity_id: r.features for r in batch.collect()})

    stream = live_values(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(src), 24 * hour, "2 hours")
    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    watermark = rows[-1][2] - 2 * hour
    batch = entity_state.latest_values(spark.createDataFrame(rows + late, schema), ttl_us=24 * hour, as_of_us=watermark)
    want = {r.entity_id: r.features for r in entity_state.feature_maps(batch).collect()}
    assert {k: v for k, v in newest.items() if v} == want and want["K0"]["late"] == "kept" and len(newest) == 7 and 0 < len(want) < 7
    held = spark.read.format("statestore").option("stateVarName", "values").load(str(tmp_path / "cp"))
    assert held.where("user_map_value IS NOT NULL").count() == sum(map(len, want.values()))
