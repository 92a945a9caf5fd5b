"""Rounding of doubles to decimal places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(column: str | Column, places: int) -> Column:
    """F.round of a double, to the last bit, without its decimal number for each row.

    Scaled by 10 ** places a value under 2 ** 40 is off by less than 0.001, so its nearest integer is the one that F.round
    finds, unless it lies that close to a half. Those few, and large or non-finite values, go to F.round.
    """
    column = F.col(column) if isinstance(column, str) else column
    scaled = column * 10.0**places
    near = F.rint(scaled)
    # rint keeps the sign of zero, F.round doesn't.
    return F.when((F.abs(scaled - near) < 0.499) & (F.abs(scaled) < 2.0**40), near / 10.0**places + 0.0).otherwise(F.round(column, places))
