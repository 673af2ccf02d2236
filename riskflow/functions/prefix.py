"""Running totals along an order without putting a whole group into one task.

A plain window over one key (or over no key at all) sends every row of the key to
one task. Here each row is first placed in nested cells that follow the order;
totals are scanned per level over cells only, and rows are scanned inside their
finest cell only. A scan never sees more rows than one level has cells, or one
finest cell has rows, however large the key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 16


def unit_cells(unit: Column, levels: int = 2, bits: int = CELL_BITS) -> list[Column]:
    """Nested integer cells of a number in [0, 1]; scaling by a power of two is exact."""
    size = float(2**bits)
    cells, rest = [], F.least(F.greatest(unit.cast("double"), F.lit(0.0)), F.lit(1.0))
    for _ in range(levels):
        scaled = rest * F.lit(size)
        cell = F.coalesce(F.floor(scaled), F.lit(0))  # never null: no filter is pushed, so scans are shared
        cells.append(cell)
        rest = scaled - cell
    return cells


def span_unit(value: Column, low: Column, high: Column) -> Column:
    """Place ``value`` in [0, 1] between its bounds; monotone, a constant span gives 0."""
    return F.when(high > low, (value - low).cast("double") / (high - low).cast("double")).otherwise(F.lit(0.0))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    cells: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<s>_before`` (and ``<s>_total``) for sums and ``<m>_before`` for maxima.

    ``cells`` are columns from coarse to fine that agree with ``order``: a row in a
    smaller cell comes earlier. ``descending`` reverses cells and order together.
    """
    keys, cells = list(keys), list(cells)

    def direction(names: Sequence[str]) -> list[Column]:
        return [F.col(n).desc() if descending else F.col(n).asc() for n in names]

    def before(names_sum: Sequence[str], names_max: Sequence[str], window) -> list[Column]:
        w = window.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_{s}") for s in names_sum] + [
            F.max(m).over(w).alias(f"_{m}") for m in names_max
        ]

    def part(names: Sequence[str]):
        return Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))

    totals = []
    current = df
    for depth in range(len(cells), 0, -1):
        current = current.groupBy(*keys, *cells[:depth]).agg(
            *[F.sum(s).alias(s) for s in sums], *[F.max(m).alias(m) for m in maxes]
        )
        totals.append(current)

    carry = None
    for depth, level in enumerate(reversed(totals), start=1):
        on = keys + cells[: depth - 1]
        window = part(on).orderBy(*direction([cells[depth - 1]]))
        scanned = level.select(
            *on,
            cells[depth - 1],
            *before(sums, maxes, window),
            *([F.sum(s).over(part(keys)).alias(f"{s}_total") for s in sums] if depth == 1 else []),
        )
        if carry is None:
            carry = scanned
            continue
        up = carry.select(
            *on,
            *[F.col(f"_{n}").alias(f"_up_{n}") for n in (*sums, *maxes)],
            *[f"{s}_total" for s in sums],
        )
        carry = scanned.join(up.hint("merge"), on).select(
            *on,
            cells[depth - 1],
            *[(F.col(f"_{s}") + F.col(f"_up_{s}")).alias(f"_{s}") for s in sums],
            *[F.greatest(f"_{m}", f"_up_{m}").alias(f"_{m}") for m in maxes],
            *[f"{s}_total" for s in sums],
        )

    inside = df.select("*", *before(sums, maxes, part(keys + cells).orderBy(*direction(order))))
    up = carry.select(
        *keys,
        *cells,
        *[F.col(f"_{n}").alias(f"_up_{n}") for n in (*sums, *maxes)],
        *[f"{s}_total" for s in sums],
    )
    own = [c for c in df.columns if c not in cells or c in order]
    # Both sides are dealt by these columns already. Neither is sent whole: sizes guessed from files miss what was decoded and exploded.
    return inside.join(up.hint("merge"), keys + cells).select(
        *own,
        *[(F.col(f"_{s}") + F.col(f"_up_{s}")).alias(f"{s}_before") for s in sums],
        *[F.greatest(f"_{m}", f"_up_{m}").alias(f"{m}_before") for m in maxes],
        *[f"{s}_total" for s in sums],
    )


def ordered_totals(
    grouped: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Sequence[str],
    unit: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Running totals of a table with one row per (keys, value), in order of ``value``.

    ``unit`` places the value in [0, 1]; left out, the value is a probability.
    """
    first, second = unit_cells(F.col(value) if unit is None else unit)
    cells = grouped.withColumn("_cell1", first).withColumn("_cell2", second)
    return running_totals(cells, keys, ["_cell1", "_cell2"], [value], sums, descending=descending)
