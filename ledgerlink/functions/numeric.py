"""Numeric helpers that give the same value on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, places: int) -> Column:
    """Half-up rounding of a double through ``floor``; no decimal text involved."""
    scale = float(10**places)
    return F.floor(value.cast("double") * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole in double, null when whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """Share in percent, 0 when the whole is empty."""
    return F.coalesce(round_half_up(ratio(part, whole) * 100.0, places), F.lit(0.0))


def money(value: Column) -> Column:
    return value.cast("decimal(15,2)")
