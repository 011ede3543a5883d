from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breadthline.operators import indicators
from breadthline.operators import universe as u
from breadthline.sources import panel, readers, sinks, trades
from tests.helpers import bars_of, by_symbol, day, series, snapshot_of, walk


def write(path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_constituents_file(spark, tmp_path):
    good = write(tmp_path / "u.csv", "Company Name,Industry,Symbol,Series\n"
                                     "One, Metals , AAA ,EQ\nTwo,Banks,DUMMYX,EQ\nThree,Banks,BBB,EQ\n")
    rows = readers.read_constituents(spark, good)
    assert {r["Symbol"] for r in rows.collect()} == {"AAA", "BBB"}
    for name, text, why in (
        ("a", "Symbol\nAAA\n", "miss required"),
        ("b", "Symbol,Industry\nAAA,\n", "missing Symbol or Industry"),
        ("c", "Symbol,Industry\n\" \",Metals\n", "empty"),
        ("d", "Symbol,Industry\nAAA,Metals\nAAA,Metals\n", "duplicate"),
    ):
        with pytest.raises(u.UniverseError, match=why):
            readers.read_constituents(spark, write(tmp_path / f"{name}.csv", text))


@pytest.mark.parametrize("header", ["company_id,name,industry", "companyId,Name,Industry"])
def test_candidate_file(spark, tmp_path, header):
    path = write(tmp_path / "c.csv", f"{header}\nNSE:BAJAJ_AUTO,Bajaj Auto Limited,Autos\n"
                                     "nse: abc ,Abc Limited Co,Metals\nBSE:XYZ,Xyz,Metals\n"
                                     "NSE:,Nothing,Metals\nNSE:BAJAJ_AUTO,Second,Autos\n")
    rows = {r["Symbol"]: r for r in readers.read_candidates(spark, path).collect()}
    assert set(rows) == {"BAJAJ-AUTO", "ABC"}
    assert rows["BAJAJ-AUTO"]["Company Name"] == "Bajaj Auto Ltd"
    assert rows["ABC"]["Company Name"] == "Abc Limited Co"
    with pytest.raises(u.UniverseError):
        readers.read_candidates(spark, write(tmp_path / "x.csv", "company_id,name\nNSE:A,B\n"))


def test_liquidity_is_clipped_at_the_first_session(spark):
    full = series("FULL", "2026-01-01", [1.0] * 100)
    young = series("YOUNG", "2026-03-23", [1.0] * 19)
    newest = series("NEWEST", "2026-04-08", [1.0] * 3)
    thin = full.assign(symbol="THIN").iloc[::2]
    blank = series("BLANK", "2026-01-01", [float("nan")] * 100)
    got = {r["symbol"]: (r["traded"], r["possible"], r["admitted"]) for r in u.liquidity(
        bars_of(spark, pd.concat([full, young, newest, thin, blank]))).collect()}
    assert got == {"FULL": (60, 60, True), "YOUNG": (19, 19, True), "NEWEST": (3, 3, False),
                   "THIN": (30, 60, False), "BLANK": (0, 0, False)}


def universe_rows(spark):
    return spark.createDataFrame(
        [("AAA", "One", "Metals", "EQ"), ("BBB", "Two", "Banks", "EQ")],
        "Symbol string, `Company Name` string, Industry string, Series string")


def test_merge_restrict_remove(spark):
    base = universe_rows(spark)
    more = spark.createDataFrame([("AAA", "Other", "Banks"), ("CCC", "New", "Banks")],
                                 "Symbol string, `Company Name` string, Industry string")
    merged = u.merge(base, more)
    assert by_symbol(merged, "Company Name") == {"AAA": "One", "BBB": "Two", "CCC": "New"}
    assert by_symbol(merged, "Series")["CCC"] == "EQ"
    strange = more.withColumn("Industry", F.lit("Insurance"))
    with pytest.raises(u.UniverseError, match="Insurance"):
        u.merge(base, strange)
    assert u.merge(base, strange, ["Insurance"]).count() == 3
    kept, gone = u.restrict(base, more)
    assert [r["Symbol"] for r in kept.collect()] == ["AAA"]
    assert [r["Symbol"] for r in gone.collect()] == ["BBB"]
    kept, gone = u.remove(base, more)
    assert [r["Symbol"] for r in gone.collect()] == ["AAA"]


def test_provider_symbol(spark):
    rows = spark.createDataFrame([("AAA",), (" BBB.ns ",), (" ",)], "s string")
    got = [r[0] for r in rows.select(u.provider_symbol("s")).collect()]
    assert got == ["AAA.NS", "BBB.ns", None]


def test_bars_from_trades_count_what_they_are_told(spark):
    lines = spark.createDataFrame(
        [("A", "2026-01-01", 10.0, 1.0, "F", "N"), ("A", "2026-01-01", 60.0, 3.0, "O", "R"),
         ("A", "2026-01-02", 5.0, 1.0, "O", "R")],
        "s string, d string, v double, q double, status string, back string")
    rows = trades.bars_from_trades(
        lines, F.col("s"), F.col("d"), F.col("v"), F.col("q"),
        F.col("status") == "F", F.col("back") != "R").orderBy("date").collect()
    assert [(r["close"], r["high"], r["low"], r["volume"]) for r in rows] == [
        (10.0, 20.0, 10.0, 1.0), (None, 5.0, 5.0, 0.0)]


def test_wide_response(spark):
    wide = spark.createDataFrame(
        [("2026-01-01", 1.0, 10.0, None), ("2026-01-02", None, None, 3.0)],
        "Date string, `A.NS|Close` double, `A.NS|Volume` double, `B.NS|Close` double")
    rows = {(r["symbol"], str(r["date"])): (r["close"], r["volume"])
            for r in readers.long_bars(wide).collect()}
    assert rows == {("A.NS", "2026-01-01"): (1.0, 10.0), ("B.NS", "2026-01-02"): (3.0, None)}
    with pytest.raises(ValueError):
        readers.long_bars(wide.select("Date"))


def test_parts_meet_the_table_of_symbols_not_the_lines(spark):
    """With nine tenths of the lines in one symbol: the same bars, merged on both sides of the join."""
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(4000) < 0.9, rng.integers(0, 3, 4000), rng.integers(3, 40, 4000))
    lines = spark.createDataFrame(pd.DataFrame({
        "k": keys, "d": pd.to_datetime("2026-01-01") + pd.to_timedelta(rng.integers(0, 9, 4000), "D"),
        "v": rng.integers(1, 9000, 4000) / 4.0, "q": rng.integers(0, 50, 4000).astype(float)}))
    names = spark.createDataFrame([(k, "HOT" if k < 3 else f"S{k % 5}") for k in range(40)],
                                  "id long, name string")
    arguments = (F.col("d"), F.col("v"), F.col("q"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = trades.trade_parts(lines, F.col("k"), *arguments)
        bars = trades.bars_from_parts(parts.join(names, F.col("key") == F.col("id")), F.col("name"))
        plan = bars._jdf.queryExecution().executedPlan().toString()
        joined = plan[plan.index("SortMergeJoin"):]
        assert "HashAggregate(keys=[key" in joined and "partial_sum" in joined
        assert "partial_sum" in plan[:plan.index("SortMergeJoin")]
        whole = trades.bars_from_trades(
            lines.join(names, F.col("k") == F.col("id")), F.col("name"), *arguments)
        assert sorted(map(tuple, bars.collect())) == sorted(map(tuple, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def response(folder, tickers: int, sessions: int = 3) -> str:
    """Two files of wide lines, each under the header; some cells empty or no numbers."""
    folder.mkdir()
    names = [f"T{i}.NS|{f}" for i in range(tickers) for f in ("Close", "Volume", "High")]
    for part in range(2):
        lines = [",".join(["Date", *names])]
        for d in range(sessions):
            cells = ["" if (i + d) % 5 == 0 else "n/a" if (i + d) % 7 == 0 else f"{i}.{d}"
                     for i in range(len(names))]
            lines.append(",".join([f"2026-0{part + 1}-0{d + 1} 00:00:00", *cells]))
        (folder / f"{part}.csv").write_text("\r\n".join(lines) + "\r\n\r\n")
    return str(folder)


def test_wide_response_files(spark, tmp_path):
    path = response(tmp_path / "some", 11)
    got = {(r["symbol"], str(r["date"])): (r["close"], r["volume"], r["high"])
           for r in readers.read_wide_response(spark, path).collect()}
    want = {}
    for part in range(2):
        for d in range(3):
            for t in range(11):
                cells = [None if (i + d) % 5 == 0 or (i + d) % 7 == 0 else float(f"{i}.{d}")
                         for i in range(3 * t, 3 * t + 3)]
                if any(x is not None for x in cells):
                    want[f"T{t}.NS", f"2026-0{part + 1}-0{d + 1}"] = tuple(cells)
    assert got == want
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("Close\n1\n")
    with pytest.raises(ValueError, match="header"):
        readers.read_wide_response(spark, str(tmp_path / "none"))


def test_the_plan_of_a_wide_response_does_not_grow(spark, tmp_path):
    """The same number of expressions for ten and two thousand tickers, and no shuffle."""
    sizes = []
    for tickers in (10, 2000):
        rows = readers.read_wide_response(spark, response(tmp_path / f"t{tickers}", tickers))
        plan = rows._jdf.queryExecution().analyzed().toString()
        sizes.append((plan.count("get("), plan.count("cast("), plan.count("#"), plan.count("CASE")))
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.select("symbol").distinct().count() == tickers
    assert sizes[0] == sizes[1]


def test_panel(spark, tmp_path):
    bars = bars_of(spark, pd.concat([walk("A", 1, 100), walk("B", 2, 100, blanks=.2),
                                     walk("ONE", 3, 1)]))
    path = str(tmp_path / "panel")
    panel.write_panel(panel.panel_of(indicators.trend_frame(bars)), path)
    stored = panel.read_panel(spark, path)
    assert panel.series(stored, "A").count() == 100
    assert panel.series(stored, "NONE").count() == 0
    plan = panel.series(stored, "A")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(symbol,A)" in plan
    tails = {r["symbol"]: r["closes"] for r in panel.tails(stored, 30).collect()}
    assert set(tails) == {"A", "B"} and len(tails["A"]) == 30 and len(tails["B"]) < 30
    same = snapshot_of(spark, [{"Symbol": "A", "Date": day("2026-08-21")}])
    assert panel.panel_matches(stored, same) is None
    other = snapshot_of(spark, [{"Symbol": "A", "Date": day("2026-08-20")}])
    assert "2026-08-21" in panel.panel_matches(stored, other)


def test_research_reader_fills_names_and_recomputes(spark, tmp_path):
    path = write(tmp_path / "research.csv",
                 "Symbol,Date,Close,Stage,RS_Score,U_D,Industry,Breakout,Breakout_Confirmed,"
                 "Extended_20Pct,Below_50DMA,Ext_Pct\n"
                 "AAA ,2026-08-21,10,Stage 2 — Advancing,85,inf,,True,False,False,False,5\n"
                 "ZZZ,bad,x,,nan,,Own,,,,,\n")
    rows = {r["Symbol"]: r for r in
            readers.read_research(spark, path, universe_rows(spark)).collect()}
    assert (rows["AAA"]["Industry"], rows["AAA"]["Company Name"]) == ("Metals", "One")
    assert (rows["AAA"]["Stage_Label"], rows["AAA"]["Action"]) == ("Stage 2", "BUY")
    assert rows["ZZZ"]["Industry"] == "Own" and rows["ZZZ"]["Date"] is None
    assert rows["ZZZ"]["Close"] is None and rows["ZZZ"]["Action"] == "WAIT"


def test_breadth_reader_drops_bad_dates(spark, tmp_path):
    path = write(tmp_path / "b.csv", "Date,Symbols\n2026-01-02,5\nnever,6\n2026-01-01,4\n")
    assert [r["Symbols"] for r in readers.read_breadth(spark, path).collect()] == [4.0, 5.0]


def test_csv_download_has_every_row(spark, tmp_path):
    rows = snapshot_of(spark, [{"Symbol": f"S{i}"} for i in range(120)])
    path = sinks.download_csv(rows, str(tmp_path / "out"))
    assert spark.read.csv(path, header=True).count() == 120
