"""Ratios, rounding and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codetally.fixed_values import WALD_Z


def ratio(part: Column, whole: Column) -> Column:
    """Share as a double; zero when there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(F.try_divide(part.cast("double"), whole.cast("double")))


def percent(part: Column, whole: Column) -> Column:
    """Percentage as a double; zero when there is nothing to share."""
    return F.when(whole == 0, 0.0).otherwise(F.try_divide(100 * part.cast("double"), whole.cast("double")))


def round_half_even(value: Column, places: int) -> Column:
    """Round scaled values to the nearest even integer, as numeric Python does."""
    scale = float(10**places)
    return F.rint(value * scale) / scale


def wald_half_width(share: Column, n: Column) -> Column:
    """Half the width of the 95 % Wald interval of a proportion."""
    return WALD_Z * F.sqrt(F.try_divide(share * (1 - share), n.cast("double")))


def f_score(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(F.try_divide(2 * (precision * recall), total))
