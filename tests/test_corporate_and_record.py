from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.operators import corporate, record
from tests.helpers import bars_of, day, series, snapshot_of

START = "2026-01-05"


def test_known_and_unknown_jumps(spark):
    bars = bars_of(spark, pd.concat([
        series("CALM", START, [100, 119, 96.4, 100.0]),
        series("SPLIT", START, [100, 101, 50.5, 51.0]),
        series("SPIN", START, [100, 100, 35.1]),
        series("REVERSE", START, [100, 100, 500.0]),
        series("BLANK", START, [100, np.nan, 101, np.nan, 102]),
    ]))
    got = {r["Symbol"]: r for r in corporate.scan(bars).collect()}
    assert set(got) == {"SPLIT", "SPIN", "REVERSE"}
    assert (got["SPLIT"]["Date"], got["SPLIT"]["Looks_Like"], got["SPLIT"]["Kind"]) == (
        day("2026-01-07"), "1:2 split or 1:1 bonus", "split/bonus")
    assert got["SPIN"]["Looks_Like"] == c.NO_CLEAN_RATIO and got["SPIN"]["Kind"] == "unclassified"
    assert got["REVERSE"]["Looks_Like"] == "5:1 reverse split" and got["REVERSE"]["Move_Pct"] == 400.0
    assert [r["Symbol"] for r in corporate.worst_first(corporate.scan(bars)).collect()][0] == "REVERSE"


def test_since_limits_events_not_prices(spark):
    bars = bars_of(spark, series("A", START, [100, 50, 100.0]))
    assert [r["Date"] for r in corporate.scan(bars, since=day("2026-01-06")).orderBy("Date").collect()] == [
        day("2026-01-06"), day("2026-01-07")]


def test_ratio_classes(spark):
    ratios = [0.5, 0.519, 0.521, 0.0, -1.0, math.inf, 10.0]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "i int, r double")
    found = rows.orderBy("i").select(corporate.classify_ratio(F.col("r")).alias("x")).collect()
    assert [r["x"]["label"] for r in found] == [
        "1:2 split or 1:1 bonus", "1:2 split or 1:1 bonus", c.NO_CLEAN_RATIO, "unusable price",
        "unusable price", "unusable price", "10:1 reverse split"]
    assert found[3]["x"]["gap"] is None


def test_half_open_span(spark):
    bars = bars_of(spark, series("A", START, [100, 100, 50, 50.0]))
    spans = spark.createDataFrame([
        ("A", day("2026-01-07"), day("2026-01-08")), ("A", day("2026-01-06"), day("2026-01-07")),
        ("A", day("2026-01-01"), day("2026-01-31")), ("NONE", day("2026-01-01"), day("2026-01-31")),
    ], "symbol string, start date, end date")
    got = {(r["symbol"], r["start"].day): r["spans_jump"]
           for r in corporate.discontinuities(bars, spans).collect()}
    assert got == {("A", 7): False, ("A", 6): True, ("A", 1): True, ("NONE", 1): False}


def test_mass_failure_and_flags(spark):
    assert [corporate.is_mass_failure(n, 750) for n in (14, 15)] == [False, True]
    assert [corporate.is_mass_failure(n, 10) for n in (7, 8)] == [False, True]
    frames = [series(f"S{i}", START, [100, 50.0]) for i in range(8)]
    with pytest.raises(corporate.MassEventError):
        corporate.report(bars_of(spark, pd.concat(frames)), day("2026-01-06"), 10)
    events = corporate.report(bars_of(spark, pd.concat(frames[:2])), day("2026-01-06"), 10)
    rows = snapshot_of(spark, [{"Symbol": "S0"}, {"Symbol": "CLEAN"}])
    got = {r["Symbol"]: (r["Corporate_Action"], r["Corporate_Action_Date"], r["Corporate_Action_Kind"])
           for r in corporate.flag_rows(rows, events).collect()}
    assert got == {"S0": (True, "2026-01-06", "1:2 split or 1:1 bonus"), "CLEAN": (False, "", "")}


# --- record ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def members(spark):
    rows = spark.createDataFrame([
        ("A", "BUY★", c.STAGE_LABELS["Stage 2"], "95", "True", "false"),
        ("B", "BUY", c.STAGE_LABELS["Stage 2"], "80", "false", "1"),
        ("C", "WATCH★", c.STAGE_LABELS["Stage 1"], "99", "true", "0"),
        ("D", "SELL", c.STAGE_LABELS["Stage 2"], "79.9", "no", None),
        ("E", "HOLD", "", None, None, None),
    ], "Symbol string, Action string, Stage string, RS_Score string, Trend_Template_Pass string, "
       "Breakout_Confirmed string")
    return rows


def test_cohorts(members):
    got: dict[str, set] = {}
    for r in record.cohort_members(members).collect():
        got.setdefault(r["cohort"], set()).add(r["Symbol"])
    assert got == {"universe": set("ABCDE"), "buy_star": {"A"}, "stage2_rs80": {"A", "B"},
                   "trend_template": {"A", "C"}, "breakout_confirmed": {"B"}}
    with pytest.raises(KeyError):
        record.cohort_members(members, "winners")


def test_registered_rules_are_pinned():
    assert list(c.COHORTS) == ["universe", "buy_star", "stage2_rs80", "trend_template",
                               "breakout_confirmed"]
    assert c.HORIZONS_WEEKS == (4, 8, 13) and c.SETTLE_SESSIONS == 3
    before = record.rules_version()
    assert before == record.rules_version() and len(before) == 12
    saved = c.RS_LEADER
    try:
        c.RS_LEADER = 81.0
        assert record.recipe_version() != before and record.rules_version() != before
    finally:
        c.RS_LEADER = saved


def returns_of(spark, closes, start, weeks=4, **options):
    bars = bars_of(spark, series("A", START, closes))
    rows = record.forward_returns(bars, (weeks,), **options)
    return {r["snapshot_date"]: r["return_pct"] for r in rows.collect()}.get(day(start), "absent")


def test_forward_return_edges(spark):
    closes = [100.0] * 28 + [110.0, 120.0]
    assert returns_of(spark, closes, "2026-01-05") == pytest.approx(10.0)
    assert returns_of(spark, closes, "2026-01-06") == pytest.approx(20.0)
    assert returns_of(spark, closes, "2026-01-07") is None
    gap = [100.0] * 28 + [np.nan, 120.0]
    assert returns_of(spark, gap, "2026-01-05") == pytest.approx(20.0)
    assert returns_of(spark, [np.nan] + closes[1:], "2026-01-05") == "absent"
    assert returns_of(spark, [0.0] + closes[1:], "2026-01-05", guard=False) is None


def test_forward_return_refuses_a_jump_inside(spark):
    closes = [100.0] * 10 + [50.0] * 20
    assert returns_of(spark, closes, "2026-01-05") is None
    assert returns_of(spark, closes, "2026-01-05", guard=False) == pytest.approx(-50.0)
    on_start = [200.0] + [100.0] * 29
    assert returns_of(spark, on_start, "2026-01-06") == pytest.approx(0.0)


def test_pending(spark):
    calendar = spark.createDataFrame(
        [(d.date(),) for d in pd.date_range("2026-01-05", periods=32)], "date date")
    days = spark.createDataFrame([(day("2026-01-05"),), (day("2026-01-06"),)], "snapshot_date date")
    got = [(r[0], r[1]) for r in record.pending(days, None, calendar).collect()]
    assert got == [(day("2026-01-05"), 4)]
    done = spark.createDataFrame(
        [(day("2026-01-05"), 4, n) for n in c.COHORTS],
        "snapshot_date date, horizon_weeks int, cohort string")
    assert record.pending(days, done, calendar).count() == 0
    assert record.pending(days, done.limit(4), calendar).count() == 1


def test_grades(spark, members):
    dates = pd.date_range(START, periods=60)
    frames = []
    for symbol, end in (("A", 130.0), ("B", 90.0), ("C", 110.0), ("D", 100.0)):
        close = np.where(np.arange(60) < 28, 100.0, end)
        frames.append(pd.DataFrame({"symbol": symbol, "date": dates, "close": close}))
    bench = spark.createDataFrame(
        [(d.date(), 100.0 if i < 28 else 105.0) for i, d in enumerate(dates)],
        "date date, close double")
    snapshots = members.withColumn("snapshot_date", F.lit(day(START)))
    due = record.with_horizons(snapshots.select("snapshot_date").distinct()).filter(
        "horizon_weeks = 4")
    rows = record.grade(snapshots, bars_of(spark, pd.concat(frames)), bench, due, day("2026-03-01"))
    got = {r["cohort"]: r for r in rows.collect()}
    assert set(got) == set(c.COHORTS)
    u = got["universe"]
    assert (u["n"], u["n_priced"], u["median_return_pct"], u["hit_rate"]) == (5, 4, 5.0, 0.5)
    assert u["mean_return_pct"] == 7.5 and u["excess_vs_universe_pp"] == 0.0
    s = got["stage2_rs80"]
    assert (s["n"], s["median_return_pct"], s["excess_vs_universe_pp"]) == (2, 10.0, 5.0)
    assert (s["benchmark_return_pct"], s["excess_vs_benchmark_pp"]) == (5.0, 5.0)
    assert got["breakout_confirmed"]["median_return_pct"] == -10.0
    none = record.grade(
        snapshots.filter("Symbol = 'E'"), bars_of(spark, pd.concat(frames)), bench, due,
        day("2026-03-01")).filter("cohort = 'buy_star'").first()
    assert (none["n"], none["n_priced"], none["median_return_pct"]) == (0, 0, None)


def test_archive_first_write_wins(spark, tmp_path):
    rows = snapshot_of(spark, [{"Symbol": "A", "Close": 1.23456, "Industry": "X"}])
    folder = str(tmp_path / "snapshots")
    first = record.archive_snapshot(rows, folder, day("2026-09-17"))
    assert first is not None
    again = record.archive_snapshot(rows.withColumn("Close", F.lit(9.0)), folder, day("2026-09-17"))
    assert again is None
    record.archive_snapshot(rows, folder, day("2026-09-18"))
    back = record.read_archive(spark, folder)
    assert "Industry" not in back.columns
    assert {(r["snapshot_date"], r["Close"]) for r in back.collect()} == {
        (day("2026-09-17"), 1.2346), (day("2026-09-18"), 1.2346)}
    with pytest.raises(ValueError, match="Action"):
        record.frozen(rows.drop("Action"), day("2026-09-19"))


def test_append_only_keeps_the_past(spark, tmp_path):
    path = str(tmp_path / "record")
    assert record.ensure_record(spark, path) and not record.ensure_record(spark, path)
    names = record.RECORD_SCHEMA.fieldNames()

    def grade(cohort, n):
        row = {"snapshot_date": day("2026-09-17"), "horizon_weeks": 4, "cohort": cohort, "n": n}
        return spark.createDataFrame([tuple(row.get(x) for x in names)], record.RECORD_SCHEMA)

    record.append_grades(spark, path, grade("universe", 5))
    record.append_grades(spark, path, grade("universe", 7).unionByName(grade("buy_star", 1)))
    rows = record.read_record(spark, path).collect()
    assert {(r["cohort"], r["n"]) for r in rows} == {("universe", 5), ("buy_star", 1)}
    merged = record.append_only(grade("universe", 5), grade("universe", 9))
    assert [r["n"] for r in merged.collect()] == [5]
    assert record.append_only(None, grade("universe", 9)).count() == 1


def test_spans_are_sorted_once_and_never_joined(spark):
    """Repeated spans, ends before starts, symbols without prices, a jump on either end; NULLs go."""
    bars = bars_of(spark, series("A", "2026-01-01", [100.0, 100.0, 10.0, 10.0, 100.0, 100.0]))
    rows = [
        ("A", "2026-01-02", "2026-01-03"), ("A", "2026-01-03", "2026-01-04"),
        ("A", "2026-01-03", "2026-01-05"), ("A", "2026-01-05", "2026-01-01"),
        ("A", "2025-01-01", "2027-01-01"), ("A", "2026-01-06", "2027-01-01"),
        ("B", "2026-01-02", "2026-01-03"), ("A", "2026-01-02", "2026-01-03"),
        (None, "2026-01-02", "2026-01-03"), ("A", None, "2026-01-03"), ("A", "2026-01-02", None)]
    spans = spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows)], "symbol string, start string, end string, nr int"
    ).selectExpr("symbol", "date(start) AS start", "date(end) AS end", "nr")
    found = corporate.discontinuities(bars, spans, 0.5)
    assert {r["nr"]: r["spans_jump"] for r in found.collect()} == {
        0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
