"""Small numeric expressions shared by all rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: str | Column) -> Column:
    """Coerce to double; text that is no number and NaN become NULL, infinity stays."""
    parsed = col(value).cast("string").try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def finite(value: str | Column) -> Column:
    """The value when it is a finite number, else NULL."""
    value = col(value)
    return F.when(~F.isnan(value) & (F.abs(value) != INFINITY), value)


def flag(condition: Column) -> Column:
    """A published flag: a missing input makes it false, never NULL."""
    return F.coalesce(condition, F.lit(False))


def truthy(value: str | Column) -> Column:
    """True for a true boolean and for the texts a CSV round trip produces."""
    return flag(F.lower(F.trim(col(value).cast("string"))).isin("true", "1"))


def percent_change(new: Column, old: Column) -> Column:
    return (F.try_divide(new, old) - 1.0) * 100.0


def count_true(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [flag(c).cast("int") for c in conditions])


def share_pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
