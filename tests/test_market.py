from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.operators import aggregates as agg
from breadthline.operators import movers, screens
from tests.helpers import day, snapshot_of

S = c.STAGE_LABELS


@pytest.fixture(scope="module")
def five(spark):
    return snapshot_of(spark, [
        {"Symbol": "A", "Stage": S["Stage 2"], "RS_Score": 95.0, "Above_MA_30W": True,
         "Near_52W_High": True, "Breakout_Confirmed": True, "Industry": "X", "R3M": .1,
         "Action": "BUY★", "Breakout": True},
        {"Symbol": "B", "Stage": S["Stage 2"], "RS_Score": 82.0, "Above_MA_30W": True,
         "Industry": "X", "R3M": .3, "Action": "BUY"},
        {"Symbol": "C", "Stage": S["Stage 3"], "RS_Score": 55.0, "Above_MA_30W": True,
         "Distribution": True, "Industry": "X", "R3M": .2, "Action": "REDUCE"},
        {"Symbol": "D", "Stage": S["Stage 4"], "RS_Score": 12.0, "Distribution": True,
         "Industry": "Y", "R3M": -.4, "Action": "SELL"},
        {"Symbol": "E", "Stage": S["Stage 1"], "Action": "AVOID"},
    ])


def test_breadth_counts(five):
    row = agg.breadth_snapshot(five).first()
    assert (row["above_ma_30w"], row["pct_above_ma_30w"], row["near_52w_high"]) == (3, 60.0, 1)
    assert (row["breakout_confirmed"], row["distribution"], row["valid_rs"]) == (1, 2, 4)
    assert (row["rs_leaders"], row["rs_lagging"], row["regime"]) == (2, 1, "Broad")
    assert [row[f"stage_{n}"] for n in range(1, 5)] == [1, 2, 1, 1]


def test_breadth_without_the_flag_reads_the_stage(five):
    row = agg.breadth_snapshot(five.drop("Above_MA_30W", "Above_MA_10W")).first()
    assert (row["above_ma_30w"], row["above_ma_30w_source"]) == (3, "stage")
    assert row["pct_above_ma_10w"] is None and row["has_ma_10w"] is False
    empty = agg.breadth_snapshot(five.filter("Symbol = 'none'")).first()
    assert (empty["symbols"], empty["regime"]) == (0, "Unavailable")


def test_breadth_history(spark):
    dates = pd.date_range("2026-01-01", periods=4)
    frame = pd.concat([
        pd.DataFrame({"symbol": "A", "date": dates, "close": [10., 11., 12., 13.], "ma_30w": 9.}),
        pd.DataFrame({"symbol": "B", "date": dates, "close": [8., 8., 8., 12.], "ma_30w": 10.}),
    ])
    frame["ma_10w"] = np.nan
    frame["date"] = frame["date"].dt.date
    frame["recency"] = [4, 3, 2, 1] * 2
    trends = spark.createDataFrame(frame).withColumn("ma_10w", F.lit(None).cast("double"))
    rows = agg.breadth_history(trends).orderBy("date").collect()
    assert [r["above_ma_30w"] for r in rows] == [1, 1, 1, 2]
    assert (rows[0]["pct_above_ma_30w"], rows[-1]["pct_above_ma_30w"]) == (50.0, 100.0)
    assert rows[0]["pct_above_ma_10w"] is None
    assert agg.breadth_history(trends, sessions=2).count() == 2
    thin = trends.withColumn("ma_30w", F.when(F.col("symbol") == "A", F.col("ma_30w")))
    assert agg.breadth_history(thin, min_coverage=1.0).count() == 0


def test_industries(five):
    rows = {r["Industry"]: r for r in agg.industry_leadership(five).collect()}
    assert set(rows) == {"X", "Y", "Unclassified"}
    assert (rows["X"]["Median_RS"], rows["X"]["Median_R3M"], rows["X"]["Stage2"]) == (82.0, .2, 2)
    assert rows["X"]["Participation_Pct"] == 100.0 and rows["Y"]["Participation_Pct"] == 0.0
    assert rows["Unclassified"]["Median_RS"] is None
    board = {r["Industry"]: r for r in agg.industry_actions(five).collect()}
    assert (board["X"]["Buy"], board["X"]["Reduce"], board["Y"]["Sell"]) == (2, 1, 1)
    assert None in board


def test_distributions(five):
    actions = {r["Action"]: r["Stocks"] for r in agg.action_distribution(five).collect()}
    assert list(actions) == list(c.ACTIONS) and actions["HOLD"] == 0 and actions["BUY★"] == 1
    assert {r["Stage"]: r["Stocks"] for r in agg.stage_distribution(five).collect()} == {
        "Stage 1": 1, "Stage 2": 2, "Stage 3": 1, "Stage 4": 1}
    assert agg.stage2_regime(five).first()["regime"] == "Selective participation"


@pytest.fixture(scope="module")
def pair(spark):
    before = [
        {"Symbol": "A", "Stage": S["Stage 1"], "Breakout": False, "Above_MA_10W": False,
         "Action": "WATCH", "RS_Score": 40.0},
        {"Symbol": "B", "Stage": S["Stage 2"], "Breakout": False, "Above_MA_10W": True,
         "Action": "HOLD", "RS_Score": 85.0},
        {"Symbol": "C", "Stage": S["Stage 2"], "Breakout": True, "Above_MA_10W": True,
         "Action": "BUY", "RS_Score": 90.0},
        {"Symbol": "GONE", "Stage": S["Stage 2"], "RS_Score": 1.0, "Action": "BUY"},
    ]
    now = [
        {"Symbol": "A", "Stage": S["Stage 2"], "Breakout": True, "Above_MA_10W": True,
         "Action": "BUY", "RS_Score": 62.0},
        {"Symbol": "B", "Stage": S["Stage 3"], "Breakout": False, "Above_MA_10W": False,
         "Action": "REDUCE", "RS_Score": 80.0},
        {"Symbol": "C", "Stage": S["Stage 2"], "Breakout": True, "Above_MA_10W": True,
         "Action": "BUY", "RS_Score": 91.0},
        {"Symbol": "FRESH", "Stage": S["Stage 4"], "RS_Score": 99.0, "Action": "SELL"},
    ]
    return snapshot_of(spark, now), snapshot_of(spark, before)


def test_transitions(pair):
    moved = {}
    for r in movers.transitions(*pair).collect():
        moved.setdefault(r["Symbol"], set()).add(r["group"])
    assert moved == {
        "A": {"Entered Stage 2 — Advancing", "New breakout setup", "Reclaimed the 10-week line",
              "Action changed"},
        "B": {"Left Stage 2 — Advancing", "Lost the 10-week line", "Action changed"},
    }
    counts = {r[0]: r[1] for r in movers.transition_counts(*pair).collect()}
    assert counts["Action changed"] == 2


def test_a_field_missing_on_one_side_is_no_change(pair):
    now, before = pair
    groups = {r["group"] for r in movers.transitions(now, before.drop("Breakout")).collect()}
    assert "New breakout setup" not in groups and "Lost the 10-week line" in groups


def test_rs_movers_and_stage_changes(pair):
    rows = movers.rs_movers(*pair, count=2).collect()
    assert [(r["Symbol"], r["RS_Change"]) for r in rows] == [("A", 22.0), ("B", -5.0)]
    changes = {r["Symbol"]: (r["Stage_From"], r["Stage_To"])
               for r in movers.stage_changes(*pair).collect()}
    assert changes == {"A": ("Stage 1", "Stage 2"), "B": ("Stage 2", "Stage 3")}


def test_screens_and_paging(spark, five):
    assert {r["Symbol"] for r in screens.preset(five, "Exit now").collect()} == {"C", "D"}
    assert {r["Symbol"] for r in screens.preset(five, "Buy candidates").collect()} == {"A", "B"}
    assert {r["Symbol"] for r in screens.screen(five, rs_low=50, rs_high=90).collect()} == {"B", "C"}
    assert screens.screen(five, search="[").count() == 0
    assert {r["Symbol"] for r in screens.screen(five, industry="X", actions=["BUY"]).collect()} == {"B"}
    many = snapshot_of(spark, [
        {"Symbol": f"S{i:03}", "RS_Score": None if i == 0 else float(i % 99)} for i in range(120)])
    pages = [screens.page(many, "RS (high to low)", n).collect() for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [50, 50, 20]
    assert len({r["Symbol"] for p in pages for r in p}) == 120
    assert pages[2][-1]["Symbol"] == "S000"
    assert screens.page_count(many).first()["pages"] == 3
    assert screens.page_count(many.limit(0)).first()["pages"] == 1
    assert screens.top_symbol(five).first()["Symbol"] == "A"


def test_setups_stack(spark):
    rows = snapshot_of(spark, [
        {"Symbol": "two", "Trend_Template_Pass": True, "VCP_Setup": True, "Liquid_UI_Filter": True},
        {"Symbol": "ready", "Stage1_Readiness": 4.0, "Liquid_UI_Filter": True},
        {"Symbol": "thin", "VCP_Setup": True, "Liquid_UI_Filter": False},
    ])
    assert [r["Symbol"] for r in screens.setups(rows, "Stacked (2+)").collect()] == ["two"]
    assert [r["Symbol"] for r in screens.setups(rows, "Stage 1 ready").collect()] == ["ready"]
    loose = screens.setups(rows, "Contracting base", liquid_only=False)
    assert {r["Symbol"] for r in loose.collect()} == {"two", "thin"}


def test_range_position(spark):
    from breadthline.functions import rules

    rows = snapshot_of(spark, [
        {"Symbol": "mid", "Low_52W": 10.0, "Close": 15.0, "High_52W": 20.0, "Date": day("2026-01-01")},
        {"Symbol": "over", "Low_52W": 10.0, "Close": 25.0, "High_52W": 20.0},
        {"Symbol": "flat", "Low_52W": 10.0, "Close": 10.0, "High_52W": 10.0},
        {"Symbol": "none", "Close": 10.0},
    ])
    position = rules.range_position(F.col("Low_52W"), F.col("Close"), F.col("High_52W"))
    got = {r["Symbol"]: r["p"] for r in rows.select("Symbol", position.alias("p")).collect()}
    assert got == {"mid": 50.0, "over": 100.0, "flat": None, "none": None}
