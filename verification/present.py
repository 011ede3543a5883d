"""The form in which both engines hand over a result.

Doubles at six decimals (sums run in different orders), dates as text. A column
list such as "Symbol, Date:d, Close:f" drives the Spark select and the SQL
select alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Prices are cents over whole quantities, so exact halves at the sixth decimal are
# common and the engines round them differently; a small shift leaves no ties.
OFF_TIES = 1.3e-08


def _parse(columns: str) -> list[tuple[str, str]]:
    out = []
    for item in columns.replace("\n", " ").split(","):
        name, _, kind = item.strip().partition(":")
        out.append((name, kind))
    return out


def tidy(rows: DataFrame, columns: str) -> DataFrame:
    chosen = []
    for name, kind in _parse(columns):
        value = F.col(f"`{name}`")
        if kind == "f":
            value = F.round(value.cast("double") + OFF_TIES, 6)
            value = F.when(value == 0, F.lit(0.0)).otherwise(value)
        elif kind == "d":
            value = value.cast("date").cast("string")
        elif kind == "i":
            value = value.cast("bigint")
        chosen.append(value.alias(name))
    return rows.select(*chosen)


def tidy_sql(columns: str, source: str) -> str:
    chosen = []
    for name, kind in _parse(columns):
        quoted = f'"{name}"'
        value = quoted
        if kind == "f":
            rounded = f"round(CAST({quoted} AS DOUBLE) + {OFF_TIES!r}, 6)"
            value = f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded} END"
        elif kind == "d":
            value = f"strftime(CAST({quoted} AS DATE), '%Y-%m-%d')"
        elif kind == "i":
            value = f"CAST({quoted} AS BIGINT)"
        chosen.append(f"{value} AS {quoted}")
    return f"SELECT {', '.join(chosen)} FROM {source}"
