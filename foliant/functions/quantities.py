"""Units, tolerances and other numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import js_round


def lux_to_fc(lux: Column) -> Column:
    return js_round(lux / 10, 1)


def m_to_ft(m: Column) -> Column:
    return js_round(m * 3.28084, 1)


def height(text: Column) -> Column:
    """Metres of a height cell; ``TS``, zero, and what is no number are null."""
    return F.nullif(text.try_cast("double"), F.lit(0.0))


def tm24_eligible(horizontal: Column, vertical: Column) -> Column:
    return F.coalesce(horizontal.rlike("^[P-Y]$"), F.lit(False)) | F.coalesce(vertical.rlike("^[P-Y]$"), F.lit(False))


def tolerance(predicted: Column, target: Column, share: float = 0.1) -> Column:
    return F.when(predicted < target * (1 - share), "under").when(predicted > target * (1 + share), "over").otherwise("ok")


def age_adjusted(lux: Column, over_65: Column) -> Column:
    return F.when(over_65, lux * 2).otherwise(lux)


def coefficient_of_variation(x: Column) -> Column:
    return F.stddev_pop(x) / F.avg(x)


def uniformity(x: Column) -> Column:
    return F.max(x) / F.min(x)


def upper_median(x: Column) -> Column:
    """The element in the middle, the later of two."""
    values = F.array_sort(F.collect_list(x))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, js_round(part * 100.0 / whole).cast("long"))
