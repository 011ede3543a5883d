"""Daily bars out of a table of trade lines.

A bar is an aggregate of sums, a maximum and a minimum only: the close is the
volume-weighted average price of the session. Such aggregates combine on the
map side, so a symbol that holds a third of all lines sends one partial row per
session and task, not its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: What a bar is made of; every part merges with others of its kind.
PARTS = {"value": F.sum, "quantity": F.sum, "high": F.max, "low": F.min, "volume": F.sum}


def trade_parts(
    trades: DataFrame, key: Column, date: Column, value: Column, quantity: Column,
    counts_for_close: Column | None = None, counts_for_volume: Column | None = None,
) -> DataFrame:
    """(key, date and PARTS) from lines of value and quantity, merged before they move.

    The key is what the lines themselves carry. A table that says to which symbol a key belongs is
    joined to the parts (`bars_from_parts`), so that it meets one row per key and session: neither
    the lines nor a symbol that holds a third of them are shuffled for it.
    """
    closing = F.lit(True) if counts_for_close is None else counts_for_close
    traded = F.lit(True) if counts_for_volume is None else counts_for_volume
    lines = trades.select(
        key.alias("key"), date.cast("date").alias("date"),
        value.alias("value"), quantity.alias("quantity"),
        closing.alias("closing"), traded.alias("traded"),
    )
    price = F.try_divide("value", "quantity")
    return lines.groupBy("key", "date").agg(
        F.sum(F.when(F.col("closing"), F.col("value"))).alias("value"),
        F.sum(F.when(F.col("closing"), F.col("quantity"))).alias("quantity"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.sum(F.when(F.col("traded"), F.col("quantity")).otherwise(0.0)).alias("volume"),
    )


def bars_from_parts(parts: DataFrame, symbol: Column) -> DataFrame:
    """bars(symbol, date, close, high, low, volume); parts of one symbol and session are merged."""
    merged = parts.select(symbol.cast("string").alias("symbol"), "date", *PARTS).groupBy(
        "symbol", "date").agg(*[merge(name).alias(name) for name, merge in PARTS.items()])
    return merged.select(
        "symbol", "date", F.try_divide("value", "quantity").alias("close"), "high", "low", "volume")


def bars_from_trades(
    trades: DataFrame, symbol: Column, date: Column, value: Column, quantity: Column,
    counts_for_close: Column | None = None, counts_for_volume: Column | None = None,
) -> DataFrame:
    """Bars of lines that carry their symbol.

    `counts_for_close` limits the lines that set the close; a session without
    one has no close yet. `counts_for_volume` does the same for the volume, where
    a session without one has traded zero.
    """
    parts = trade_parts(trades, symbol.cast("string"), date, value, quantity, counts_for_close,
                        counts_for_volume)
    return parts.select(
        F.col("key").alias("symbol"), "date", F.try_divide("value", "quantity").alias("close"),
        "high", "low", "volume")


def index_from_trades(trades: DataFrame, date: Column, value: Column,
                      quantity: Column) -> DataFrame:
    """benchmark(date, close): the volume-weighted price of everything traded that day."""
    return trades.groupBy(date.cast("date").alias("date")).agg(
        F.try_divide(F.sum(value), F.sum(quantity)).alias("close")
    )
