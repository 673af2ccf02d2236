"""History features per entity: exact rolling windows (VEL1-2) and prior statistics (VEL3-7).

The six entities become rows, ``(entity, key, time, amount)``, so one narrow shuffle
serves all of them. A row sees only rows that come earlier in the order
``(event time, transaction_sequence_id, transaction_id)``.

Two ways to compute the same numbers:

* *windows*: window frames per key, all of them growing from the key's first row: a
  rolling value is the running total at the row minus the one at its window's start,
  in parts that add up without rounding. A row costs the same whatever its windows
  hold; a key is one task, so this serves keys up to a limit.
* *totals*: a rolling value is the running total at the row minus the running total
  at the start of its window. Window starts are added as extra rows and both are
  scanned by :func:`riskflow.functions.prefix.running_totals`, whose tasks stay small
  whatever the size of a key. Amounts are centred on the key's mean, which keeps the
  differences accurate.

``strategy="auto"`` counts rows per cell of hashed keys, per key only if a cell has more rows
than a key may have, and sends only keys above the limit down the second way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.config import ENTITIES, WINDOWS_US
from riskflow.functions.prefix import running_totals, span_unit
from riskflow.functions.spread import tasks

ROLLING_LIMIT = 1_000_000
PRIOR_LIMIT = 2_000_000

_TIME_BITS = 20
_TIE_BITS = 16
_KEY = ["entity", "entity_id"]
#: Cells of hashed keys in which rows are counted before any key is counted by itself.
_SIZE_CELLS = 1 << 16
_ORDER = ["us", "seq", "transaction_id"]
PRIOR_STATS = ["n_prior", "avg_prior", "std_prior", "prev_us"]


def entity_rows(df: DataFrame, entities: Mapping[str, str] = ENTITIES, keep: list[str] | None = None, anchor: bool = False, keyless: bool = False) -> DataFrame:
    """One narrow row per transaction and entity; an entity without a key has no history.

    ``anchor`` adds one row per transaction under the entity '', so that one without any key is not lost; ``keyless`` adds it to those without any key only.
    """
    pairs = [F.struct(F.lit(e).alias("entity"), F.col(c).cast("string").alias("entity_id")) for e, c in entities.items()]
    if anchor or keyless:
        own = F.struct(F.lit("").alias("entity"), F.coalesce(F.col("transaction_id"), F.lit("")).alias("entity_id"))
        pairs.append(own if anchor else F.when(F.coalesce(*[F.col(c).cast("string") for c in entities.values()]).isNull(), own))
    pairs = F.array(*pairs)
    return (
        df.select(
            "transaction_id",
            F.unix_micros("event_timestamp").alias("us"),
            F.coalesce(F.col("transaction_sequence_id"), F.lit(0)).cast("bigint").alias("seq"),
            F.coalesce(F.col("amount"), F.lit(0.0)).alias("amount"),
            *(keep or []),
            F.explode(pairs).alias("_pair"),
        )
        .select("transaction_id", "us", "seq", "amount", *(keep or []), "_pair.entity", "_pair.entity_id")
        .where("entity_id IS NOT NULL")
    )


def _rolling_names(windows: Mapping[str, int]) -> list[str]:
    return [f"{kind}_{w}" for w in windows for kind in ("n", "sum")]


def _parts(amount: Column) -> dict[str, Column]:
    """``amount`` in parts whose running totals differ exactly: multiples of 2**20 and of 2**-12, which add up as whole numbers, a rest below 2**-12,
    and a number that counts values that are no numbers (not a number, infinite, negative infinite: 21 bits each).
    """
    finite = F.when(F.isnan(amount) | (F.abs(amount) == float("inf")), 0.0).otherwise(amount)
    high = F.floor(finite / float(2**20)).cast("double")
    rest = finite - high * float(2**20)
    low = F.floor(rest * float(2**12)).cast("double")
    odd = F.when(F.isnan(amount), 1 << 42).when(amount == float("inf"), 1 << 21).when(amount == float("-inf"), 1).otherwise(0)
    return {"_high": high, "_low": low, "_rest": rest - low / float(2**12), "_odd": odd.cast("bigint")}


def _whole(high: Column, low: Column, rest: Column, odd: Column) -> Column:
    """The sum that totals of ``_parts`` stand for."""
    nan, up, down = F.shiftright(odd, 42), F.shiftright(odd, 21).bitwiseAND((1 << 21) - 1), odd.bitwiseAND((1 << 21) - 1)
    some = F.when((nan > 0) | ((up > 0) & (down > 0)), float("nan")).when(up > 0, float("inf")).otherwise(float("-inf"))
    return F.when(odd != 0, some).otherwise(high * float(2**20) + (low / float(2**12) + rest))


def _by_windows(rows: DataFrame, windows: Mapping[str, int], prior: bool) -> DataFrame:
    by_row = Window.partitionBy(*_KEY).orderBy(*_ORDER)
    before = by_row.rowsBetween(Window.unboundedPreceding, -1)
    by_time = Window.partitionBy(*_KEY).orderBy("us")
    parts = _parts(F.col("amount"))

    def totals(frame, suffix: str) -> list[Column]:
        return [F.count(F.lit(1)).over(frame).alias(f"_n{suffix}")] + [F.coalesce(F.sum(c).over(frame), F.lit(0)).alias(f"{c}{suffix}") for c in parts]

    out = rows.withColumns(parts) if windows else rows
    out = out.select(
        "*",
        *([
            (F.row_number().over(by_row) - 1).cast("bigint").alias("n_prior"),
            F.coalesce(F.avg("amount").over(before), F.lit(0.0)).alias("avg_prior"),
            F.coalesce(F.stddev_samp("amount").over(before), F.lit(0.0)).alias("std_prior"),
            F.lag("us").over(by_row).alias("prev_us"),
        ] if prior else []),
        *(totals(before, "_at") if windows else []),
    )
    if windows:
        # What came before the row in the total order, less what came before its window's first instant.
        out = out.select("*", *[c for name, width in windows.items() for c in totals(by_time.rangeBetween(Window.unboundedPreceding, -width - 1), f"_to_{name}")])
        rolled: list[Column] = []
        for name in windows:

            def inside(c: str, name: str = name) -> Column:
                # rows without a time are each other's window
                start = F.col(f"{c}_to_{name}")
                return F.col(f"{c}_at") + F.when(F.col("us").isNull(), start).otherwise(-start)

            rolled.append(inside("_n").alias(f"n_{name}"))
            rolled.append(F.when(inside("_n") == 0, 0.0).otherwise(_whole(*[inside(c) for c in parts])).alias(f"sum_{name}"))
        out = out.select(*rows.columns, *(PRIOR_STATS if prior else []), *rolled)
    return out


def key_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("n_key"),
        F.min("us").alias("us_lo"),
        F.max("us").alias("us_hi"),
        F.min("seq").alias("seq_lo"),
        F.max("seq").alias("seq_hi"),
        F.avg("amount").alias("centre"),
    )


def _by_totals(rows: DataFrame, stats: DataFrame, windows: Mapping[str, int], prior: bool) -> DataFrame:
    carried = [c for c in rows.columns if c not in (*_KEY, "us", "seq", "transaction_id", "amount")]
    located = rows.join(stats, _KEY)  # ``stats`` says how: rows are never sent whole, however small their files are
    # Each row, and one probe per window at the row's window start. A probe counts for
    # nothing and sorts before every row of its instant.
    probes = F.array(
        F.struct(F.lit("").alias("window"), F.lit(0).cast("bigint").alias("width")),
        *[F.struct(F.lit(w).alias("window"), F.lit(us).cast("bigint").alias("width")) for w, us in windows.items()],
    )
    is_row = F.col("window") == ""
    tie = F.floor(span_unit(F.col("seq"), F.col("seq_lo"), F.col("seq_hi")) * float(2**_TIE_BITS - 1)) + 1
    position = span_unit(F.col("at"), F.col("us_lo"), F.col("us_hi"))
    marks = (
        located.select("*", F.explode(probes).alias("_p"))
        .select("*", "_p.window", (F.col("us") - F.col("_p.width")).alias("at"))
        .select(
            *_KEY,
            "transaction_id",
            "us",
            "seq",
            "amount",
            "centre",
            *carried,
            "window",
            "at",
            is_row.cast("int").alias("ord"),
            F.coalesce(F.floor(F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0)) * float(2**_TIME_BITS)), F.lit(0)).alias("cell"),
            F.coalesce(F.when(is_row, tie).otherwise(-tie), F.lit(0)).alias("tie"),
            is_row.cast("bigint").alias("n"),
            F.when(is_row, F.col("amount") - F.col("centre")).otherwise(0.0).alias("d"),
            F.when(is_row, F.pow(F.col("amount") - F.col("centre"), F.lit(2.0))).otherwise(0.0).alias("d2"),
            F.when(is_row, F.col("us")).alias("last"),
            F.when(is_row, F.col("amount")).alias("hi"),
            F.when(is_row, -F.col("amount")).alias("lo"),
        )
    )
    scanned = running_totals(
        marks, _KEY, ["cell", "at", "tie"], ["at", "ord", "seq", "transaction_id", "window"], ["n", "d", "d2"], ["last", "hi", "lo"]
    )

    def at(window: str, column: str) -> Column:
        return F.max(F.when(F.col("window") == window, F.col(column)))

    merged = scanned.groupBy("transaction_id", *_KEY, "us", "seq", "amount", *carried).agg(
        F.max("centre").alias("_m"),
        at("", "n_before").alias("_n"),
        at("", "d_before").alias("_d"),
        at("", "d2_before").alias("_d2"),
        at("", "last_before").alias("_last"),
        (at("", "hi_before") + at("", "lo_before")).alias("_range"),
        *[at(w, f"{c}_before").alias(f"_{c}_{w}") for w in windows for c in ("n", "d")],
    )
    features: list[Column] = []
    n, d, m = F.col("_n"), F.col("_d"), F.col("_m")
    if prior:
        variance = (F.col("_d2") - d * d / F.greatest(n, F.lit(1))) / F.greatest(n - 1, F.lit(1))
        # Equal amounts leave rounding noise in the sums; their range tells them apart.
        spread = (n > 1) & (F.col("_range") > 0)
        features += [
            n.alias("n_prior"),
            F.when(n > 0, m + d / F.greatest(n, F.lit(1))).otherwise(0.0).alias("avg_prior"),
            F.when(spread, F.sqrt(F.greatest(variance, F.lit(0.0)))).otherwise(0.0).alias("std_prior"),
            F.col("_last").alias("prev_us"),
        ]
    for w in windows:
        count = n - F.col(f"_n_{w}")
        features.append(count.alias(f"n_{w}"))
        features.append(F.when(count > 0, d - F.col(f"_d_{w}") + m * count).otherwise(0.0).alias(f"sum_{w}"))
    return merged.select("transaction_id", "us", "seq", "amount", *carried, *_KEY, *features)


def entity_history(
    rows: DataFrame,
    windows: Mapping[str, int] | None = None,
    prior: bool = True,
    strategy: str = "auto",
    limit: int | None = None,
) -> DataFrame:
    """History columns for :func:`entity_rows`: ``n_<w>``, ``sum_<w>`` and the prior statistics."""
    return _history(rows, dict(windows or {}), prior, strategy, limit)[0]


def _most(rows: DataFrame, *by: Column | str) -> tuple[int, int]:
    """How many rows there are, and how many the largest group has."""
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_key")).agg(F.sum("n_key").alias("n"), F.max("n_key").alias("largest")).first()
    return sizes["n"] or 0, sizes["largest"] or 0


def _history(rows: DataFrame, windows: Mapping[str, int], prior: bool, strategy: str, limit: int | None) -> tuple[DataFrame, int | None]:
    """``entity_history`` and, where rows were counted, the number of tasks that many rows take."""
    limit = limit or (ROLLING_LIMIT if windows else PRIOR_LIMIT)
    if strategy == "windows":
        return _by_windows(rows, windows, prior), None
    stats = key_stats(rows)
    if strategy == "totals":
        return _by_totals(rows, stats.hint("merge"), windows, prior), None
    n, most = _most(rows, F.pmod(F.xxhash64(*_KEY), F.lit(_SIZE_CELLS)))
    n_tasks = tasks(rows, n)
    if most <= limit or _most(rows, *_KEY)[1] <= limit:
        return _by_windows(rows.repartition(n_tasks, *_KEY), windows, prior), n_tasks
    # few by construction: each has more than ``limit`` rows
    large = F.broadcast(stats.where(F.col("n_key") > limit))
    small_rows = rows.join(F.broadcast(large.select(*_KEY)), _KEY, "left_anti").repartition(n_tasks, *_KEY)
    small = _by_windows(small_rows, windows, prior)
    return small.unionByName(_by_totals(rows, large, windows, prior).select(*small.columns)), n_tasks


def _feature_columns(entity: str, windows: Mapping[str, int], prior: bool) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for w in windows:
        out[f"{entity}_txn_count_{w}"] = F.col(f"n_{w}")
        out[f"{entity}_amount_sum_{w}"] = F.col(f"sum_{w}")
    if prior:
        avg, std = F.col("avg_prior"), F.col("std_prior")
        z = (F.col("amount") - avg) / F.when(std == 0, F.lit(1.0)).otherwise(std)
        out[f"{entity}_total_txn_count"] = F.col("n_prior")
        out[f"{entity}_avg_amount"] = avg
        out[f"{entity}_std_amount"] = std
        out[f"time_since_prev_{entity}_txn_seconds"] = F.coalesce((F.col("us") - F.col("prev_us")) / 1e6, F.lit(-1.0))
        out[f"amount_zscore_{entity}"] = F.greatest(F.least(z, F.lit(10.0)), F.lit(-10.0))
    return out


def feature_names(entities: Mapping[str, str] = ENTITIES, windows: Mapping[str, int] | None = None, prior: bool = True) -> list[str]:
    out: list[str] = []
    for e in entities:
        for w in windows or {}:
            out += [f"{e}_txn_count_{w}", f"{e}_amount_sum_{w}"]
        if prior:
            out += [f"{e}_total_txn_count", f"{e}_avg_amount", f"{e}_std_amount", f"time_since_prev_{e}_txn_seconds", f"amount_zscore_{e}"]
    return out


def velocity(
    df: DataFrame,
    entities: Mapping[str, str] = ENTITIES,
    windows: Mapping[str, int] | None = WINDOWS_US,
    prior: bool = True,
    history: DataFrame | None = None,
    strategy: str = "auto",
    limit: int | None = None,
    keyed: bool = False,
) -> DataFrame:
    """One row per transaction of ``df`` with the features of every entity.

    A transaction is an id, a time and a sequence number together: rows that share only the id stay apart, and one whose entities
    all lack keys has the features of a first transaction. ``keyed`` returns time and sequence number too (``us``, ``seq``).
    ``history`` holds other transactions whose rows count as past but are not returned
    (SPL5); rows are told apart by a tag, not by position.
    """
    windows = dict(windows or {})
    rows = entity_rows(df, entities, keyless=True)
    if history is not None:
        rows = (
            entity_rows(df.withColumn("_target", F.lit(True)), entities, ["_target"], keyless=True)
            .unionByName(entity_rows(history.withColumn("_target", F.lit(False)), entities, ["_target"]))
        )
    computed, n_tasks = _history(rows, windows, prior, strategy, limit)
    if history is not None:
        computed = computed.where("_target")
    by = ("transaction_id", "us", "seq")
    if n_tasks is not None:
        # the narrow rows move, and a task aggregates whole transactions
        computed = computed.repartition(n_tasks, *by)
    wide = widen(computed, entities, windows, prior, by=by)
    return wide if keyed else wide.drop("us", "seq")


def widen(computed: DataFrame, entities: Mapping[str, str] = ENTITIES, windows: Mapping[str, int] | None = None, prior: bool = True, carry: Sequence[str] = (),
          by: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """History rows (one per transaction and entity) as one row of features per transaction."""
    # Absent entities take the defaults of a first transaction.
    first_time = {f"time_since_prev_{e}_txn_seconds": -1.0 for e in entities}
    wide: list[Column] = []
    for entity in entities:
        for name, column in _feature_columns(entity, windows or {}, prior).items():
            value = F.max(F.when(F.col("entity") == entity, column))
            if name.startswith("amount_zscore_"):
                default = F.max(F.greatest(F.least(F.col("amount"), F.lit(10.0)), F.lit(-10.0)))
            else:
                default = F.lit(first_time.get(name, 0))
            wide.append(F.coalesce(value, default).alias(name))
    return computed.groupBy(*by).agg(*[F.max(c).alias(c) for c in carry], *wide)
