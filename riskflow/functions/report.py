"""Rounding at the report edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Added before rounding, in units of the last reported digit. Sums and means of short decimals often sit exactly on a rounding midpoint, where the
#: order of additions decides; less than a thousandth moves them off it. It has no short decimal form itself, so it puts no such value onto one.
OFFSET = 0.000731058578630005


#: A product below the first is known to a quarter of the second: two roundings of 2**-53 of it, one of adding a half.
SURE, MARGIN = float(2**40), 2.0**-10


def guard(digits: int) -> float:
    return OFFSET * 10.0**-digits


def rounded(c: Column | str, digits: int = 4) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    moved = col.cast("double") + F.lit(guard(digits))
    if digits < 0:
        return F.round(moved, digits)
    # Spark rounds by way of decimal text. Where the product with a power of ten is known well enough to tell the side of the midpoint, the quotient
    # of two whole numbers is the same number; values beyond, near a midpoint, missing or no numbers take Spark's way.
    ten = float(10**digits)
    scaled = moved * F.lit(ten)
    clear = (F.abs(scaled) < SURE) & (F.abs(scaled - F.floor(scaled) - 0.5) > MARGIN)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(ten)).otherwise(F.round(moved, digits))
