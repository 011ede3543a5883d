"""The window specifications that all per-symbol operators share.

Functions, because a window needs a running session. One partitioning and one
order per direction, so that Spark sorts a symbol's rows once.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol")


def newest_first() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(F.desc("day"))


def oldest_first() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day")


def so_far() -> WindowSpec:
    """From the newest row down to this one."""
    return newest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def newer() -> WindowSpec:
    """All rows newer than this one."""
    return newest_first().rowsBetween(Window.unboundedPreceding, -1)


def up_to_here() -> WindowSpec:
    """From the oldest row up to this one."""
    return oldest_first().rowsBetween(Window.unboundedPreceding, Window.currentRow)
