"""Exact linear-interpolated quantiles from ordered counts, or by refining histograms; no group is ever collected."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskflow.functions.prefix import ordered_totals, span_unit


def quantiles_of(ordered: DataFrame, keys: Sequence[str], value: str, count: str, qs: Sequence[float]) -> DataFrame:
    """``(keys, q, quantile)`` from running totals of ``count`` in order of ``value``.

    Each quantile needs the values at two ranks; the rows that hold them are picked
    by comparing running totals.
    """
    marks = F.array(*[F.lit(float(q)) for q in qs])
    rank = (F.col(f"{count}_total") - 1) * F.col("q")
    first, last = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count) - 1
    low, high = F.floor(rank), F.ceil(rank)
    holds_low, holds_high = low.between(first, last), high.between(first, last)
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    return (
        ordered.where(F.col(count) > 0)
        .withColumn("q", F.explode(marks))
        .where(holds_low | holds_high)
        .groupBy(*keys, "q")
        .agg(
            F.max(F.when(holds_low, F.col(value))).alias("a"),
            F.max(F.when(holds_high, F.col(value))).alias("b"),
            F.max(rank - low).alias("t"),
        )
        .select(*keys, "q", (a + (b - a) * t).alias("quantile"))
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Quantiles of ``value`` per key; nulls and NaN are left out."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        spans = counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        located = counts.join(spans, list(keys))
    else:
        spans = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("_one", F.lit(1))
        located = counts.withColumn("_one", F.lit(1)).join(F.broadcast(spans), "_one")  # one row
    ordered = ordered_totals(located, list(keys), "v", ["n"], unit=span_unit(F.col("v"), F.col("lo"), F.col("hi")))
    return quantiles_of(ordered, keys, "v", "n", qs)


@dataclass
class _Span:
    """The values of one key from ``low`` to ``high``, with ``below`` rows under them and the ranks looked for among them."""

    key: str
    low: float
    high: float
    below: int
    n: int
    ranks: list[int]

    def settled(self) -> dict[int, float]:
        """Ranks whose values are known: all of a single value, else the first and the last."""
        if self.low == self.high:
            return dict.fromkeys(self.ranks, self.low)
        ends = {self.below: self.low, self.below + self.n - 1: self.high}
        return {r: ends[r] for r in self.ranks if r in ends}

    def wide(self) -> bool:
        """Values of many magnitudes, which cells of equal width would not part."""
        small, large = sorted((abs(self.low), abs(self.high)))
        return self.low <= 0 <= self.high or large > 4096 * small


_SPANS = "span int, key string, low double, high double, scale double, by_magnitude boolean, cells int, below long, ranks array<long>"


def _magnitude(v: Column) -> Column:
    """A monotone number of a double that grows by one with every doubling, from the smallest double up; negative values mirrored."""
    size = F.log2(F.abs(v)) + 1075.0
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0.0)


def _narrowed(rows: DataFrame, spans: Sequence[_Span], cells: int, magnitudes: bool) -> list[_Span]:
    """One pass: a histogram over the cells of each span, of which the cells that hold a rank are the next spans."""
    described = [
        (i, s.key, s.low, s.high, 1.0 if math.isfinite(s.high - s.low) else 0.5, magnitudes and s.wide(), cells, s.below, s.ranks)
        for i, s in enumerate(spans)
    ]
    # As many rows as the caller asks for quantiles.
    table = F.broadcast(rows.sparkSession.createDataFrame(described, _SPANS))
    v, low, high, scale = F.col("_v"), F.col("low"), F.col("high"), F.col("scale")
    even = (v * scale - low * scale) / (high * scale - low * scale)
    by_magnitude = (_magnitude(v) - _magnitude(low)) / (_magnitude(high) - _magnitude(low))
    unit = F.when(F.col("by_magnitude"), by_magnitude).otherwise(even)
    before = Window.partitionBy("span").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    held = (
        rows.join(table, (F.col("_k") == F.col("key")) & v.between(low, high))
        .groupBy("span", F.least(F.floor(unit * F.col("cells")), F.col("cells") - 1).alias("cell"))
        .agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(table, "span")
        .withColumn("earlier", F.col("earlier") + F.col("below"))
        .withColumn("inside", F.filter("ranks", lambda r: (r >= F.col("earlier")) & (r < F.col("earlier") + F.col("n"))))
        .where(F.size("inside") > 0)
        .select("key", "lo", "hi", "earlier", "n", "inside")
        .collect()
    )
    return [_Span(*row) for row in held]


def refined_quantiles(df: DataFrame, key: str, value: str, count: str, qs: Sequence[float], cells: int = 16384) -> DataFrame:
    """``(key, q, quantile)`` of finite doubles weighted by whole ``count``s, for a bounded number of text keys that are not null.

    Every pass reads the rows once and shuffles at most ``cells`` counts a key and task, however many different values there are. The
    cells that hold a wanted rank are parted again until a cell is one value. Passes alternate between cells of equal width and of equal
    magnitude, so a far outlier costs one pass. The driver holds at most two spans for each key and quantile.
    """
    rows = df.where(F.col(count) > 0).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(count).cast("long").alias("_n"))
    whole = rows.groupBy("_k").agg(F.min("_v"), F.max("_v"), F.sum("_n")).collect()  # one row a key
    found: dict[tuple[str, int], float] = {}
    spans = []
    for name, low, high, n in whole:
        ranks = {f((n - 1) * q) for q in qs for f in (math.floor, math.ceil)}
        spans.append(_Span(name, low, high, 0, n, sorted(ranks)))
    passes = 0
    while True:
        left = []
        for s in spans:
            known = s.settled()
            found.update({(s.key, r): x for r, x in known.items()})
            s.ranks = [r for r in s.ranks if r not in known]
            if s.ranks:
                left.append(s)
        if not left:
            break
        # The first pass has one span a key; later ones share its cells between their spans.
        spans = _narrowed(rows, left, cells if passes == 0 else max(2, cells // (2 * len(qs))), passes % 2 == 1)
        passes += 1
    out = []
    for name, _, _, n in whole:
        for q in qs:
            rank = (n - 1) * q
            a, b = found[name, math.floor(rank)], found[name, math.ceil(rank)]
            out.append((name, float(q), a + (b - a) * (rank - math.floor(rank))))
    return df.sparkSession.createDataFrame(out, f"{key} string, q double, quantile double")
