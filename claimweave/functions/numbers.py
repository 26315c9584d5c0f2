"""Rounding by the exact value of a binary number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 ** 27 + 1, which splits a double into two halves whose products are exact.
SPLIT = 134217729.0


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * SPLIT
    high = big - (big - x)
    return high, x - high


def exact_round(x: Column, digits: int) -> Column:
    """``x`` to so many decimal places (0 to 15): the nearest by the exact value of the double, a tie to the even last place.

    ``round`` goes by the shortest text of a number, by which 2.675 (a little less in binary) is a tie. Here twice the scaled number is
    compared with the odd whole number between both candidates, with the error of the product, which is computed
    exactly. Null, infinities and NaN stay as they are; numbers that scaled pass 2 ** 51, which have hardly such places, go by ``round``."""
    scale = 10.0**digits
    y = x * scale
    low = F.floor(y).cast("double")
    odd = low * 2 + 1
    product = x * (2 * scale)
    (a, b), (c, d) = _halves(x), _halves(F.lit(2 * scale))
    error = ((a * c - product) + a * d + b * c) + b * d
    over = (product - odd) + error
    up = F.when(over > 0, 1.0).when(over < 0, 0.0).otherwise(F.pmod(low, F.lit(2.0)))
    odd_one = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x.isNull() | odd_one, x).when(F.abs(y) >= 2.0**51, F.round(x, digits)).otherwise((low + up) / scale)
