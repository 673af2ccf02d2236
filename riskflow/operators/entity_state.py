"""Per-entity state as tables: counters, latest values and context (ST1-6, batch side)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.functions.prefix import running_totals, span_unit, unit_cells
from riskflow.functions.spread import tasks
from riskflow.operators.velocity import PRIOR_LIMIT, entity_rows

#: Width of a bucket of rows that are added up, and how late a row may come.
BUCKET_US = 3_600_000_000
LATENESS_US = 3_600_000_000


def gap_counters(rows: DataFrame, ttl_us: int, keys: Sequence[str] = ("entity", "entity_id")) -> DataFrame:
    """ST2: counters that restart after a silence of at least ``ttl_us``.

    Rows of one time slot no longer than the gap always share a counter, so they are
    added up per slot first, before anything moves; the counter's start is then found
    over slots. Slots per key are limited by the time covered, not by the rows.
    """
    keys = list(keys)
    slots = rows.groupBy(*keys, F.floor(F.col("us") / F.lit(ttl_us)).alias("slot")).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )
    in_order = Window.partitionBy(*keys).orderBy("slot")
    starts = (F.col("first_us") - F.lag("last_us").over(in_order) >= ttl_us).cast("int")
    numbered = slots.withColumn("_new", F.coalesce(starts, F.lit(1))).withColumn("session", F.sum("_new").over(in_order))
    return numbered.groupBy(*keys, "session").agg(
        F.min("first_us").alias("start_us"),
        F.max("last_us").alias("end_us"),
        F.sum("n").alias("txn_count"),
        F.sum("amount").alias("amount_sum"),
    )


def latest_values(updates: DataFrame, order: Sequence[str] = ("us", "seq"), ttl_us: int | None = None, as_of_us: int | None = None) -> DataFrame:
    """ST3: the newest value of every (entity, feature) in a table of updates.

    With ``ttl_us`` a value expires that long after its last update; those expired at ``as_of_us`` are not returned, nor shuffled.
    """
    if ttl_us is not None:
        updates = updates.where(F.col("us") > as_of_us - ttl_us)
    return updates.groupBy("entity", "entity_id", "feature").agg(F.max_by("value", F.struct(*order)).alias("value"))


def transaction_updates(df: DataFrame, features: Mapping[str, Column], entities: Mapping[str, str] = ENTITIES) -> DataFrame:
    """Feature updates written by transactions: one row per entity and feature."""
    named = df.select("transaction_id", "event_timestamp", "transaction_sequence_id", "amount", *entities.values(),
                      *[c.cast("string").alias(f"_f_{n}") for n, c in features.items()])
    # A transaction becomes a row per entity and feature; a small file holds so many that a task's aggregate would sort them all at once.
    named = named.repartition(tasks(df, df.count() * len(entities) * max(1, len(features))), "transaction_id", "event_timestamp", "transaction_sequence_id")
    rows = entity_rows(named, entities, [f"_f_{n}" for n in features])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_f_{n}").alias("value")) for n in features])
    return rows.select("entity", "entity_id", "us", "seq", F.explode(pairs).alias("u")).select(
        "entity", "entity_id", "us", "seq", "u.feature", "u.value"
    )


def feature_maps(latest: DataFrame) -> DataFrame:
    """ST4: all features of an entity as one map; its size is the number of feature names."""
    return latest.groupBy("entity", "entity_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "value")))).alias("features")
    )


def snapshot(df: DataFrame, entities: Mapping[str, str] = ENTITIES) -> DataFrame:
    """ST1/ST6: state after all rows of ``df``: count, mean, squared deviation and last time."""
    return entity_rows(df, entities).groupBy("entity", "entity_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount").alias("amount_sum"),
        F.avg("amount").alias("mean_amount"),
        (F.var_pop("amount") * F.count(F.lit(1))).alias("m2_amount"),
        F.max("us").alias("last_us"),
    )


def bucketed(df: DataFrame, entities: Mapping[str, str] = ENTITIES, bucket_us: int = BUCKET_US, keep_us: int = max(WINDOWS_US.values()) + LATENESS_US) -> DataFrame:
    """ST6: what a stream starts from: per key one row for each bucket of the time that windows still reach, with its rows, and one for all before.

    Columns ``entity, entity_id, bucket, n, total, mean, m2, last_us, rows``; ``bucket`` and ``rows`` are null for the time before. Moments
    are added up first; a list of rows is one key's rows of one bucket.
    """
    rows = entity_rows(df, entities).withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_us)))
    since = F.floor((F.lit(df.agg(F.max(F.unix_micros("event_timestamp"))).first()[0] or 0) - F.lit(keep_us)) / F.lit(bucket_us))
    recent = F.col("bucket") >= since
    moments = [F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), (F.var_pop("amount") * F.count(F.lit(1))).alias("m2"), F.max("us").alias("last_us")]
    listed = F.collect_list(F.struct("us", "seq", F.coalesce("transaction_id", F.lit("")).alias("id"), "amount")).alias("rows")
    old = rows.where(~recent).groupBy("entity", "entity_id").agg(*moments)
    new = rows.where(recent).groupBy("entity", "entity_id", "bucket").agg(*moments, listed)
    return new.unionByName(old, allowMissingColumns=True)


def context_as_of(df: DataFrame, versions: DataFrame, features: Sequence[str], entities: Mapping[str, str] = ENTITIES, limit: int = PRIOR_LIMIT) -> DataFrame:
    """ST5: each transaction with the newest version of its entities' features as of its time, ``<entity>_<feature>``.

    ``versions`` has one row for each time at which an entity's features were written (``entity, entity_id, us, seq`` and the features). A version of the
    transaction's own instant counts. Versions and transactions are put into one order, and the last version is carried along it: within a key, or over
    nested time cells for keys above ``limit`` rows, whose rows then need not meet in one task. Every transaction comes back once, told apart by
    ``transaction_id, us, seq`` and the number of equal rows; entities without a key or a version give null.
    """
    key, place = ["entity", "entity_id"], ["transaction_id", "us", "seq"]
    rows = entity_rows(df, entities, anchor=True)
    written = versions.select("entity", F.col("entity_id").cast("string").alias("entity_id"), "us", F.struct("us", "seq", *features).alias("version"), F.lit(0).alias("kind"))
    per_key = rows.select(*key, "us").unionByName(written.select(*key, "us")).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    sizes = per_key.agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    n_tasks = tasks(df, sizes["n"] or 0)
    asked = rows.repartition(n_tasks, *place).groupBy(*place, *key).agg(F.count(F.lit(1)).alias("times"))
    both = written.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    order, wanted = ["us", "kind", "version"], [*key, *place, "times", "kind", "version_before"]
    frame = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def along_keys(part: DataFrame) -> DataFrame:
        return part.repartition(n_tasks, *key).select("*", F.max("version").over(frame).alias("version_before")).select(*wanted)

    if (sizes["largest"] or 0) <= limit:
        carried = along_keys(both)
    else:
        # few by construction: each has more than ``limit`` rows
        large = F.broadcast(per_key.where(F.col("n") > limit).select(*key))
        first, second = unit_cells(span_unit(F.col("us"), F.lit(sizes["lo"]), F.lit(sizes["hi"])))
        located = both.join(large, key, "left_semi").withColumns({"_cell1": first, "_cell2": second})
        carried = running_totals(located, key, ["_cell1", "_cell2"], order, maxes=["version"]).select(*wanted)
        carried = along_keys(both.join(large, key, "left_anti")).unionByName(carried)
    found = carried.where("kind = 1").repartition(n_tasks, *place)
    wide = found.groupBy(*place, "times").agg(*[F.max(F.when(F.col("entity") == e, F.col(f"version_before.{f}"))).alias(f"{e}_{f}") for e in entities for f in features])
    return wide.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_n")).drop("times", "_n")


def transaction_context(df: DataFrame, state: DataFrame, features: Sequence[str], entities: Mapping[str, str] = ENTITIES) -> DataFrame:
    """ST5: each transaction with the state of its six entities, ``<entity>_<feature>``.

    One lookup for all entities. Every key has one state row, so a frequent key only
    lengthens the transaction side, which adaptive execution may split; tasks are as many as the rows take. Transactions that share an id stay apart by time and sequence
    number (fully equal ones by their count), and one without any key comes back with nulls.
    """
    place = ["transaction_id", "us", "seq"]
    n_tasks = tasks(df, df.count() * (len(entities) + 1))
    asked = entity_rows(df, entities, anchor=True).repartition(n_tasks, *place).groupBy(*place, "entity", "entity_id").agg(F.count(F.lit(1)).alias("times"))
    known = state.select("entity", "entity_id", *features).hint("merge")  # its size, guessed from a file, says nothing
    found = asked.join(known, ["entity", "entity_id"], "left").repartition(n_tasks, *place)
    wide = found.groupBy(*place, "times").agg(
        *[F.max(F.when(F.col("entity") == e, F.col(f))).alias(f"{e}_{f}") for e in entities for f in features]
    )
    return wide.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_n")).drop("us", "seq", "times", "_n")
