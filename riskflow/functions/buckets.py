"""Bucket numbers by fixed edges as one balanced CASE tree (log2(n) comparisons, no lambda)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, edges: Sequence[float], right_closed: bool = False) -> Column:
    """Number of ``edges`` below ``value``: 0 … len(edges).

    ``right_closed`` counts edges strictly below (``e < v``), otherwise edges at or
    below (``e <= v``). A null value yields null.
    """
    edges = list(edges)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(edges[mid])
        above = value > edge if right_closed else value >= edge
        return F.when(above, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return F.when(value.isNotNull(), tree(0, len(edges)))
