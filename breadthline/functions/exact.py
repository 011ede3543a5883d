"""Sums and means of doubles that do not depend on the order of the rows, as aggregate SQL text.

A double is taken apart into its whole part and its fraction in units of 2**-52, both whole numbers;
sums of whole numbers are exact in any order and on any plan. Put together again they are rounded
once. Fractions below 2**-52 are lost, which only numbers below one have. A sum takes up to 2,048
rows whatever they are; a larger one may overflow, which raises.
"""

from __future__ import annotations

UNIT = 2**52


def exact_sum(value: str, condition: str = "true") -> str:
    """Sum of `value` over the rows that meet the condition; NULL without a known value."""
    chosen = f"CASE WHEN {condition} THEN {value} END"
    whole = f"sum(CASE WHEN {condition} THEN floor({value}) END)"
    parts = f"sum(bigint(({chosen} - floor({chosen})) * {UNIT}D))"
    # The units that make up whole numbers go over to them; what is left of either is exact.
    return (f"(double({whole} + shiftright({parts}, 52)) "
            f"+ double({parts} & {UNIT - 1}L) / {UNIT}D)")


def exact_mean(value: str, condition: str = "true") -> str:
    """Mean of the known values; NULL without one."""
    count = f"count(CASE WHEN {condition} THEN {value} END)"
    return f"try_divide({exact_sum(value, condition)}, double({count}))"
