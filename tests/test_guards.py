"""Every guard on both sides of its ceiling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from breadthline.operators import boundary, guards
from tests.helpers import bars_of, day, series


def one(df):
    return tuple(df.first())[1:]


def test_closed_sessions(spark):
    def sessions(total, closed):
        return spark.range(total).select((F.col("id") < closed).alias("closed"))

    assert one(guards.closed_sessions(sessions(100, 15))) == (15, 100, 15, False)
    assert one(guards.closed_sessions(sessions(100, 16))) == (16, 100, 15, True)
    # Too few sessions to judge by.
    assert one(guards.closed_sessions(sessions(59, 59))) == (59, 59, 8, False)
    assert one(guards.closed_sessions(sessions(0, 0))) == (0, 0, 0, False)


def test_lost_and_absent_symbols(spark):
    names = spark.range(100).select(F.concat(F.lit("S"), "id").alias("symbol"))
    gone = names.filter("symbol IN ('S1', 'S2', 'S3')")
    assert one(guards.lost_symbols(names, gone.limit(2))) == (2, 100, 2, False)
    assert one(guards.lost_symbols(names, gone)) == (3, 100, 2, True)
    assert one(guards.lost_symbols(names, gone, 50.0)) == (3, 100, 50, False)
    assert one(guards.lost_symbols(names.limit(0), gone)) == (0, 0, 0, False)
    bars = bars_of(spark, pd.concat([series("S1", "2026-01-01", [1.0, 2.0])]))
    few = names.filter("symbol IN ('S1', 'S2')")
    assert one(guards.absent_symbols(few, bars)) == (1, 2, 0, True)
    assert one(guards.absent_symbols(few.filter("symbol = 'S1'"), bars)) == (0, 1, 0, False)


def test_jumps_of_the_newest_session(spark):
    def events(n):
        return spark.range(n).select(F.lit(day("2026-08-21")).alias("Date")).unionByName(
            spark.range(50).select(F.lit(day("2026-08-20")).alias("Date")))

    for rows, ceiling in ((10, 7), (1000, 19), (0, 7)):
        published = spark.range(rows)
        assert one(guards.newest_jumps(events(ceiling), day("2026-08-21"), published)) == (
            ceiling, rows, ceiling, False)
        assert one(guards.newest_jumps(events(ceiling + 1), day("2026-08-21"), published))[3]


def test_other_sessions_and_backwards(spark):
    days = [day("2026-08-21"), None, day("2026-08-20")]
    rows = spark.createDataFrame([(d,) for d in days], "Date date")
    assert one(guards.other_sessions(rows.limit(0), days[0]))[3]
    assert one(guards.other_sessions(rows, days[0])) == (1, 2, 0, True)
    assert one(guards.other_sessions(rows.filter("Date > DATE '2026-08-20'"), days[0])) == (
        0, 1, 0, False)
    assert one(guards.backwards(spark, days[0], None)) == (0, 0, 0, False)
    assert one(guards.backwards(spark, days[0], days[2])) == (0, 1, 0, False)
    assert one(guards.backwards(spark, days[2], days[0])) == (1, 1, 0, True)


def test_refusals_are_sentences(spark):
    checked = guards.table(guards.backwards(spark, day("2026-08-20"), day("2026-08-21")),
                           guards.backwards(spark, day("2026-08-21"), None))
    assert guards.refusals(checked) == ["later session published: 1 of 1, at most 0 are accepted"]
    many = pd.concat([series(f"S{i}", "2026-01-01", [5.0] * 80, volume=0.0) for i in range(21)])
    try:
        boundary.non_trading_sessions(bars_of(spark, many))
    except boundary.CoverageError as error:
        assert "closed sessions: 80 of 80" in str(error)
    else:
        raise AssertionError("not refused")
