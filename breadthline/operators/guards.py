"""What must hold before a run may publish, as one table of counts and ceilings.

Each guard is one aggregate row: how many cases there are, out of how many, how many may be, and
whether the run is refused. The daily job and the registered queries read the same rows; the job
stops on the first refusal and publishes the table with the outputs otherwise.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breadthline import config as c

CLOSED, LOST, ABSENT, JUMPS, DATES, BACKWARDS = (
    "closed sessions", "symbols without a usable history", "symbols without any history",
    "jumps in the newest session", "rows of another session", "later session published")


def _guard(rows: DataFrame, name: str, count: Column, total: Column, ceiling: Column,
           enough: Column | None = None) -> DataFrame:
    """One row over `rows`; `enough` says whether there is enough to judge by."""
    counted = rows.agg(F.coalesce(count, F.lit(0)).cast("long").alias("count"),
                       F.coalesce(total, F.lit(0)).cast("long").alias("total"))
    judged = F.lit(True) if enough is None else enough
    return counted.withColumn("ceiling", ceiling.cast("long")).select(
        F.lit(name).alias("guard"), "count", "total", "ceiling",
        (judged & (F.col("count") > F.col("ceiling"))).alias("refuse"))


def closed_sessions(sessions: DataFrame) -> DataFrame:
    """More sessions without trade than an exchange closes; `sessions` has one row each and `closed`."""
    return _guard(sessions, CLOSED, F.count_if("closed"), F.count(F.lit(1)),
                  F.floor(F.col("total") * c.MAX_CLOSED_SHARE),
                  F.col("total") >= c.MIN_SESSIONS_TO_JUDGE_RATE)


def lost_symbols(universe: DataFrame, missing: DataFrame,
                 limit_pct: float = c.MAX_UNIVERSE_LOSS_PCT) -> DataFrame:
    """Universe symbols that the snapshot lacks (`missing`: one row each)."""
    lost = universe.select("symbol").join(
        missing.select("symbol", F.lit(True).alias("lost")), "symbol", "left")
    return _guard(lost, LOST, F.count("lost"), F.count(F.lit(1)),
                  F.floor(F.col("total") * limit_pct / 100.0))


def absent_symbols(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """The strict variant: no universe symbol may be without bars."""
    known = bars.select("symbol").distinct().withColumn("known", F.lit(True))
    rows = universe.select("symbol").join(known, "symbol", "left")
    return _guard(rows, ABSENT, F.count_if(F.col("known").isNull()), F.count(F.lit(1)), F.lit(0))


def newest_jumps(events: DataFrame, boundary: dt.date, published: DataFrame) -> DataFrame:
    """Jumps of the newest session against the published symbols; many at once are a feed's fault."""
    today = events.filter(F.col("Date") == F.lit(boundary)).select(
        F.lit(1).alias("jump"), F.lit(None).cast("int").alias("row"))
    both = today.unionByName(published.select(
        F.lit(None).cast("int").alias("jump"), F.lit(1).alias("row")))
    ceiling = F.greatest(F.lit(c.MASS_EVENT_FLOOR),
                         F.ceil(F.col("total") * c.MASS_EVENT_PCT / 100.0)) - 1
    return _guard(both, JUMPS, F.count("jump"), F.count("row"), ceiling)


def other_sessions(research: DataFrame, boundary: dt.date) -> DataFrame:
    """Every dated row must be of the boundary; a snapshot without rows is refused as well."""
    off = _guard(research, DATES, F.count_if(F.col("Date") != F.lit(boundary)), F.count("Date"),
                 F.lit(0))
    return off.withColumn("refuse", F.col("refuse") | (F.col("total") == 0))


def backwards(spark: SparkSession, boundary: dt.date, published: dt.date | None) -> DataFrame:
    """Whether the published set is of a later session."""
    later = published is not None and boundary < published
    return _guard(spark.range(1), BACKWARDS, F.sum(F.lit(int(later))),
                  F.sum(F.lit(int(published is not None))), F.lit(0))


def table(*guards: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, guards)


def refusals(guards: DataFrame) -> list[str]:
    """A sentence for each refusal; the table has a row for each of a few guards."""
    return [
        f"{r['guard']}: {r['count']} of {r['total']}, at most {r['ceiling']} are accepted"
        for r in guards.filter("refuse").orderBy("guard").collect()
    ]
