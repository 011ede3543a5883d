from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breadthline.functions.exact import exact_mean, exact_sum
from breadthline.operators import indicators as ind
from breadthline.operators import ranking
from tests import brute
from tests.helpers import bars_of, by_symbol, day, series, walk


def same(a, b, tolerance=1e-9) -> bool:
    missing_a = a is None or (isinstance(a, float) and math.isnan(a))
    missing_b = b is None or (isinstance(b, float) and math.isnan(b))
    if missing_a or missing_b:
        return missing_a and missing_b
    if isinstance(b, bool):
        return a == b
    return a == b or abs(a - b) <= tolerance * max(1.0, abs(b))


@pytest.fixture(scope="module")
def histories():
    return [
        walk("PLAIN", 1),
        walk("GAPS", 2, gaps=0.25),
        walk("BLANKS", 3, blanks=0.08),
        walk("BOTH", 4, gaps=0.3, blanks=0.1),
        walk("YOUNG", 5, sessions=120),
        walk("NEW", 6, sessions=18),
        walk("YEAR", 7, sessions=262, blanks=0.02),
        walk("SPARSE", 8, gaps=0.7, blanks=0.05),
    ]


@pytest.fixture(scope="module")
def benchmark():
    rng = np.random.default_rng(99)
    dates = pd.bdate_range(end="2026-08-21", periods=620)
    close = pd.Series(20000 + np.cumsum(rng.normal(2, 60, 620)), index=dates)
    close.iloc[::17] = np.nan
    return close


def test_every_field_equals_the_plain_definition(spark, histories, benchmark):
    index = spark.createDataFrame(
        [(d.date(), None if math.isnan(v) else float(v)) for d, v in benchmark.items()],
        "date date, close double",
    )
    bars = bars_of(spark, pd.concat(histories))
    rows = {r["Symbol"]: r for r in ind.symbol_indicators(bars, index).collect()}
    for history in histories:
        symbol = history["symbol"].iloc[0]
        for field, want in brute.indicators(history, benchmark).items():
            assert same(rows[symbol][field], want), (symbol, field, rows[symbol][field], want)


def test_later_rows_change_nothing_before(spark, histories):
    bars = bars_of(spark, pd.concat(histories))
    cut = day("2026-03-04")
    early = [h[h["date"] <= pd.Timestamp(cut)] for h in histories]
    from breadthline.operators.boundary import rows_until

    full = ind.moving_averages(bars).filter(F.col("date") <= F.lit(cut))
    short = ind.moving_averages(rows_until(bars, cut))
    assert full.exceptAll(short).count() == 0 == short.exceptAll(full).count()
    assert sum(len(h) for h in early) == full.count()


def test_averages_at_every_session(spark, histories):
    bars = bars_of(spark, pd.concat(histories[1:4]))
    got = {
        (r["symbol"], pd.Timestamp(r["date"])): (r["ma_10w"], r["ma_30w"])
        for r in ind.moving_averages(bars).collect()
    }
    for history in histories[1:4]:
        close = history.set_index("date")["close"]
        known = close.dropna()
        for date in close.index:
            want = [
                brute.mean_at(known, date, weeks) if date in known.index else math.nan
                for weeks in (10, 30)
            ]
            for a, b in zip(got[(history["symbol"].iloc[0], date)], want):
                assert same(a, b)


def test_a_flat_series_is_never_above_its_line(spark):
    rows = ind.moving_averages(bars_of(spark, series("FLAT", "2025-01-01", [0.1] * 400)))
    assert rows.filter("ma_30w IS NOT NULL AND close <> ma_30w").count() == 0


def test_weekly_flat_average_and_too_short(spark):
    long = series("LONG", "2025-01-01", [100.0] * 31, "7D")
    short = series("SHORT", "2025-01-01", [100.0] * 5, "7D")
    got = ind.moving_averages(bars_of(spark, pd.concat([long, short])))
    last = {r["symbol"]: r["ma_30w"] for r in got.orderBy("date").collect()}
    assert last["LONG"] == 100.0 and last["SHORT"] is None


def test_volume_ratio_and_up_down_edges(spark):
    frames = [
        series("TENFOLD", "2025-01-01", [10.0] * 51).assign(volume=[100.0] * 50 + [1000.0]),
        series("ZERO_BASE", "2025-01-01", [10.0] * 51).assign(volume=[0.0] * 50 + [5.0]),
        series("ALL_ZERO", "2025-01-01", [10.0] * 51, volume=0.0),
        series("RISING", "2025-01-01", [float(i) for i in range(1, 22)]),
        series("ALTERNATING", "2025-01-01", [10.0 + i % 2 for i in range(21)]),
        series("CONSTANT", "2025-01-01", [10.0] * 21),
        series("TWENTY", "2025-01-01", [float(i) for i in range(1, 21)]),
    ]
    rows = ind.symbol_indicators(bars_of(spark, pd.concat(frames)))
    volume, ud = by_symbol(rows, "Volume_Ratio"), by_symbol(rows, "U_D")
    assert volume["TENFOLD"] == 10.0
    assert volume["ZERO_BASE"] == math.inf and volume["ALL_ZERO"] is None
    assert ud["RISING"] == math.inf and ud["ALTERNATING"] == 1.0
    assert ud["CONSTANT"] is None and ud["TWENTY"] is None


def test_52_week_high_needs_its_sessions(spark):
    few = series("FEW", "2025-01-01", [100.0] * 199, "2D")
    enough = series("ENOUGH", "2024-06-01", [100.0] * 400)
    rows = ind.symbol_indicators(bars_of(spark, pd.concat([few, enough])))
    assert by_symbol(rows, "High_52W") == {"FEW": None, "ENOUGH": 100.0}
    assert by_symbol(ind.symbol_indicators(bars_of(spark, few), min_sessions=100), "High_52W") == {
        "FEW": 100.0
    }


def test_without_a_low_column(spark):
    bars = bars_of(spark, walk("X", 1)).drop("low")
    row = ind.symbol_indicators(bars).first()
    assert row["Low_52W"] is None and row["ATR_Pct"] is None and row["Contraction_Ratio"] is None
    assert row["VCP_Contractions"] == 0 and row["High_52W"] is not None


def test_score_ties_and_missing(spark):
    rows = spark.createDataFrame(
        [("a", .1), ("b", .1), ("c", .2), ("d", None)], "Symbol string, RS_Blend double"
    )
    assert by_symbol(ranking.rs_score(rows), "RS_Score") == {"a": 34.0, "b": 34.0, "c": 99.0, "d": None}


def test_score_of_many_values_with_one_hot_value(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 0.5), rng.normal(0, 1, 8000).round(4)])
    frame = pd.DataFrame({"Symbol": [str(i) for i in range(12000)], "RS_Blend": values})
    want = np.rint(frame["RS_Blend"].rank(pct=True, method="min") * 98.0 + 1.0)
    got = by_symbol(ranking.rs_score(spark.createDataFrame(frame)), "RS_Score")
    assert [got[s] for s in frame["Symbol"]] == want.tolist()


def test_exact_medians(spark):
    rng = np.random.default_rng(6)
    frames = [
        pd.DataFrame({"k": "many", "x": rng.normal(0, 1, 30001)}),
        pd.DataFrame({"k": "even", "x": rng.normal(0, 1, 20000)}),
        pd.DataFrame({"k": "hot", "x": np.concatenate([np.full(9000, 2.0), rng.random(9001)])}),
        pd.DataFrame({"k": "one", "x": [3.0]}),
        pd.DataFrame({"k": "two", "x": [3.0, 4.0]}),
        pd.DataFrame({"k": "three", "x": [3.0, 9.0, 4.0]}),
    ]
    frame = pd.concat(frames, ignore_index=True)
    got = ranking.exact_medians(spark.createDataFrame(frame), ["k"], "x", "m")
    want = frame.groupby("k")["x"].median()
    assert {r["k"]: r["m"] for r in got.collect()} == pytest.approx(want.to_dict(), abs=1e-15)


def test_medians_of_one_group_with_most_rows(spark, tmp_path):
    """Nine tenths of all rows in one group, other groups small, null keys, infinite and missing."""
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(0, 1, 60_001).round(5), np.full(30_000, 0.01)])
    frame = pd.concat([
        pd.DataFrame({"k": "most", "x": values}),
        pd.DataFrame({"k": [f"g{i % 40}" for i in range(9_999)], "x": rng.normal(5, 2, 9_999)}),
        pd.DataFrame({"k": None, "x": [1.0, 2.0, 9.0, 4.0]}),
        pd.DataFrame({"k": "odd", "x": [np.inf, -np.inf, 7.0]}),
    ], ignore_index=True)
    rows = spark.createDataFrame(frame).union(
        spark.createDataFrame([("empty", None), ("odd", None)], "k string, x double"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    counts = ranking.value_counts(rows, ["k"], "x")
    sizes = [r["count"] for r in counts.groupBy("range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.35 * sum(sizes)
    found = ranking.medians(counts, ["k"], "x", "m")
    assert not any("rows" in name.split("/")[-2] for name in found.inputFiles())
    want = frame[np.isfinite(frame["x"])].groupby("k", dropna=False)["x"].median()
    want = {None if k != k else k: v for k, v in want.items()}
    assert {r["k"]: r["m"] for r in found.collect()} == pytest.approx(want, abs=1e-15)


def test_trend_chart_and_candles(spark):
    frame = pd.concat([walk("A", 1, blanks=0.05), walk("B", 2, sessions=30)])
    bars = bars_of(spark, frame)
    assert {r[0]: r[1] for r in ind.trend_frame(bars, 100).groupBy("symbol").count().collect()} == {
        "A": 100, "B": 30}
    chart = ind.chart_series(bars)
    assert [r[0] for r in chart.select("symbol").distinct().collect()] == ["A"]
    assert chart.count() == 260 and chart.filter("close IS NULL").count() == 0
    candles = ind.candle_series(bars)
    assert candles.filter("high IS NULL AND low IS NOT NULL").count() == 0


def test_exact_sums_in_any_order(spark):
    """Against correctly rounded sums: mixed sizes, signs and cancellation, rows in three orders."""
    rng = np.random.default_rng(5)
    groups = {
        "prices": np.round(rng.uniform(1, 900, 1500), 2), "values": rng.uniform(1e9, 1e12, 300),
        "cancel": np.concatenate([[1e15, 0.25], -rng.uniform(1, 2, 40), [-1e15]]),
        "one": np.array([3.7]), "flat": np.full(210, 100.1),
    }
    rows = [(g, float(x)) for g, some in groups.items() for x in some] + [("none", None)]
    for seed in range(3):
        rng.shuffle(rows)
        parts = spark.createDataFrame([(g, x if x is None else float(x)) for g, x in rows],
                                      "g string, x double").repartition(3 + seed)
        got = {r["g"]: r for r in parts.groupBy("g").agg(
            F.expr(f"{exact_sum('x')} AS total"), F.expr(f"{exact_mean('x')} AS mean"),
            F.expr(f"{exact_sum('x', 'x > 5')} AS some")).collect()}
        for g, some in groups.items():
            assert got[g]["total"] == math.fsum(some), g
            assert got[g]["mean"] == math.fsum(some) / len(some)
            big = [x for x in some if x > 5]
            assert got[g]["some"] == (math.fsum(big) if big else None)
        assert got["none"]["total"] is None and got["none"]["mean"] is None
