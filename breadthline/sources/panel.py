"""The price panel: closes of the last sessions as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def panel_of(trends: DataFrame) -> DataFrame:
    """(symbol, date, close) in single precision, from trend rows."""
    return trends.select("symbol", "date", F.col("close").cast("float").alias("close"))


def write_panel(panel: DataFrame, path: str) -> None:
    """Sorted by symbol inside each file, so that one symbol's rows are few row groups."""
    panel.repartitionByRange("symbol").sortWithinPartitions("symbol", "date").write.mode(
        "overwrite"
    ).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, date date, close float").parquet(path)


def series(panel: DataFrame, symbol: str) -> DataFrame:
    """One symbol's known closes in order; the filter reaches the scan."""
    return (
        panel.filter((F.col("symbol") == symbol) & F.col("close").isNotNull())
        .select("date", F.col("close").cast("double").alias("close")).orderBy("date")
    )


def tails(panel: DataFrame, sessions: int) -> DataFrame:
    """Each symbol's closes in the last N panel sessions, oldest first, two at least.

    The panel's N-th newest date is one scalar, so the rows are filtered, not joined.
    """
    newest = panel.select("date").distinct().orderBy(F.desc("date")).limit(sessions)
    first = newest.agg(F.min("date")).scalar()
    rows = panel.filter((F.col("date") >= first) & F.col("close").isNotNull())
    collected = rows.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("date", "close"))).alias("rows")
    )
    return collected.filter(F.size("rows") >= 2).select(
        "symbol",
        F.transform("rows", lambda r: r["close"].cast("double")).alias("closes"),
    )


def terminal_session(panel: DataFrame) -> DataFrame:
    return panel.agg(F.max("date").alias("terminal_session"))


def panel_matches(panel: DataFrame, research: DataFrame) -> str | None:
    """Why the panel must not be drawn beside this snapshot, or None."""
    end = panel.agg(F.max("date")).first()[0]
    decided = research.agg(F.max("Date")).first()[0]
    if end is None or decided is None or end == decided:
        return None
    return (
        f"The published price panel ends at {end} but this snapshot's decision date is {decided}. "
        "Price history is withheld rather than drawn against a different session."
    )
