from __future__ import annotations

import math

from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules, text
from breadthline.functions.numbers import number, truthy
from tests.helpers import by_symbol, snapshot_of

STAGE2, STAGE1 = c.STAGE_LABELS["Stage 2"], c.STAGE_LABELS["Stage 1"]


def values(spark, column, items, kind="double"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_stage_table(spark):
    rows = snapshot_of(spark, [
        {"Symbol": s, "Close": cl, "MA_30W": ma, "MA_30W_Slope_10S_Pct": sl}
        for s, cl, ma, sl in (("a", 110., 100., 1.), ("b", 110., 100., 0.), ("c", 90., 100., 0.),
                              ("d", 90., 100., 1.), ("e", 100., 100., 1.), ("f", None, 100., 1.))
    ])
    assert by_symbol(rows.withColumn("Stage", rules.stage()), "Stage") == {
        "a": c.STAGE_LABELS["Stage 2"], "b": c.STAGE_LABELS["Stage 3"],
        "c": c.STAGE_LABELS["Stage 4"], "d": c.STAGE_LABELS["Stage 1"],
        "e": c.STAGE_LABELS["Stage 1"], "f": None,
    }


def test_near_high_and_ud_bands(spark):
    rows = snapshot_of(spark, [{"Symbol": "in", "Close": 97.0, "High_52W": 100.0},
                               {"Symbol": "out", "Close": 96.99, "High_52W": 100.0},
                               {"Symbol": "none", "Close": 97.0}])
    assert by_symbol(rows.withColumn("x", F.expr(rules.NEAR_HIGH)), "x") == {
        "in": True, "out": False, "none": False}
    bands = values(spark, rules.ud_class("x"), [.59, .60, .70, 1.30, 1.31, 1.50, 1.51, math.inf, None])
    assert bands == [
        "Heavy Distribution", "Distribution Warning", "Neutral", "Neutral", "Accumulating",
        "Accumulating", "Strong Accumulation", "Strong Accumulation", "Undefined"]


def test_breakout_needs_volume_and_confirmation_needs_ud(spark):
    base = {"Stage": STAGE2, "Close": 99.0, "High_52W": 100.0, "Volume_Ratio": 2.0}
    rows = snapshot_of(spark, [
        {**base, "Symbol": "setup", "U_D": 1.2}, {**base, "Symbol": "both", "U_D": 1.31},
        {**base, "Symbol": "infinite", "U_D": math.inf},
        {**base, "Symbol": "quiet", "U_D": 2.0, "Volume_Ratio": 1.5},
        {**base, "Symbol": "stage1", "U_D": 2.0, "Stage": STAGE1},
    ])
    rows = rows.withColumn("b", F.expr(rules.BREAKOUT)).withColumn(
        "k", F.expr(rules.BREAKOUT_CONFIRMED))
    assert by_symbol(rows, "b") == {"setup": True, "both": True, "infinite": True, "quiet": False,
                                    "stage1": False}
    assert by_symbol(rows, "k") == {"setup": False, "both": True, "infinite": True, "quiet": False,
                                    "stage1": False}


ACTION_CASES = [
    ({"Stage": "Stage 4 — Declining", "RS_Score": 99.0}, "SELL"),
    ({"Stage": "Stage 3 — Topping", "RS_Score": 49.0}, "SELL"),
    ({"Stage": "Stage 3 — Topping", "RS_Score": 50.0}, "REDUCE"),
    ({"Stage": "Stage 3 — Topping"}, "REDUCE"),
    ({"Stage": STAGE1, "RS_Score": 80.0}, "WATCH★"),
    ({"Stage": STAGE1, "RS_Score": 50.0}, "WATCH"),
    ({"Stage": STAGE1, "RS_Score": 49.0}, "AVOID"),
    ({"Stage": STAGE1}, "AVOID"),
    ({}, "WAIT"),
    ({"Stage": STAGE2, "RS_Score": 90.0, "U_D": 0.69}, "REDUCE"),
    ({"Stage": STAGE2, "RS_Score": 49.0}, "WAIT"),
    ({"Stage": STAGE2, "RS_Score": 79.0, "Breakout": True}, "WAIT"),
    ({"Stage": STAGE2, "RS_Score": 79.0}, "HOLD"),
    ({"Stage": STAGE2, "RS_Score": 80.0, "Extended_20Pct": True, "Breakout_Confirmed": True}, "WAIT"),
    ({"Stage": STAGE2, "RS_Score": 80.0, "Below_50DMA": True}, "WAIT"),
    ({"Stage": STAGE2, "RS_Score": 80.0, "Breakout": True, "Breakout_Confirmed": True}, "BUY★"),
    ({"Stage": STAGE2, "RS_Score": 80.0, "Breakout": True, "U_D": math.inf}, "BUY"),
    ({"Stage": STAGE2, "RS_Score": 80.0}, "HOLD"),
]


def test_action_precedence_and_reason(spark):
    rows = snapshot_of(spark, [
        {**row, "Symbol": f"{i:02}"} for i, (row, _) in enumerate(ACTION_CASES)
    ])
    acted = rows.withColumn("Action", rules.action()).withColumn("why", text.action_reason())
    got = by_symbol(acted, "Action")
    assert [got[k] for k in sorted(got)] == [want for _, want in ACTION_CASES]
    why = by_symbol(acted, "why")
    assert why["00"] == "Stage 4 takes precedence: the guide requires SELL regardless of RS."
    assert why["09"] == "Stage 2 + RS 90; distribution warning (U/D 0.69) triggers REDUCE."
    assert "short by 1." in why["11"] and "RS needs 80" in why["11"]
    assert why["03"].startswith("Stage 3 with RS unavailable")
    assert all(why.values())


def test_template_counts_only_what_fails(spark):
    good = {"Close": 130.0, "SMA_50": 120.0, "SMA_150": 110.0, "SMA_200": 100.0,
            "SMA_200_Rising": True, "Low_52W": 100.0, "High_52W": 173.0, "RS_Score": 70.0}
    rows = snapshot_of(spark, [
        {**good, "Symbol": "all"}, {**good, "Symbol": "rs", "RS_Score": 69.9},
        {**good, "Symbol": "nolow", "Low_52W": None},
        {**good, "Symbol": "low", "Low_52W": 100.01},
    ])
    for name, test in rules.TEMPLATE.items():
        rows = rows.withColumn(name, F.expr(test))
    score = sum(F.col(n).cast("int") for n in c.TEMPLATE_FLAGS)
    assert by_symbol(rows.withColumn("score", score), "score") == {
        "all": 8, "rs": 7, "nolow": 7, "low": 7}


def test_setup_and_readiness_bounds(spark):
    setup = {"Stage": STAGE2, "Contraction_Ratio": .60, "Volume_DryUp": .80, "VCP_Contractions": 2,
             "Base_Depth_Pct": 35.0}
    rows = snapshot_of(spark, [
        {**setup, "Symbol": "yes"}, {**setup, "Symbol": "deep", "Base_Depth_Pct": 35.1},
        {**setup, "Symbol": "stage1", "Stage": STAGE1}, {**setup, "Symbol": "one", "VCP_Contractions": 1},
        {**setup, "Symbol": "nodepth", "Base_Depth_Pct": None},
    ])
    assert by_symbol(rows.withColumn("x", F.expr(rules.VCP_SETUP)), "x") == {
        "yes": True, "deep": False, "stage1": False, "one": False, "nodepth": False}
    ready = {"Stage": STAGE1, "MA_30W_Slope_10S_Pct": -.10, "RS_Score": 50.0, "Close": 11.0,
             "MA_10W": 10.0, "Contraction_Ratio": .70, "Volume_DryUp": .90}
    rows = snapshot_of(spark, [
        {**ready, "Symbol": "five"}, {**ready, "Symbol": "three", "RS_Score": None, "MA_10W": 11.0},
        {**ready, "Symbol": "stage2", "Stage": STAGE2},
    ])
    assert by_symbol(rows.withColumn("x", F.expr(rules.STAGE1_READINESS)), "x") == {
        "five": 5.0, "three": 3.0, "stage2": None}


def test_line_leads_price(spark):
    rows = snapshot_of(spark, [
        {"Symbol": "leads", "RS_Line": 99.5, "RS_Line_High_52W": 100.0, "Pct_From_52W_High": -5.0},
        {"Symbol": "price", "RS_Line": 99.5, "RS_Line_High_52W": 100.0, "Pct_From_52W_High": -4.9},
        {"Symbol": "below", "RS_Line": 99.4, "RS_Line_High_52W": 100.0, "Pct_From_52W_High": -9.0},
        {"Symbol": "zero", "RS_Line": 0.0, "RS_Line_High_52W": 0.0, "Pct_From_52W_High": -9.0},
    ])
    assert by_symbol(rows.withColumn("x", F.expr(rules.LINE_LEADS_PRICE)), "x") == {
        "leads": True, "price": False, "below": False, "zero": False}


def test_bands_formats_and_coercions(spark):
    cases = [
        (rules.regime("x"), [85., 60., 59.9, 40., 39.9, 0., None],
         ["Broad", "Broad", "Mixed", "Mixed", "Narrow", "Narrow", "Unavailable"]),
        (rules.extension_band("x"), [89., 75., 20., 2., 1.9, -2., -2.1, None],
         ["very extended", "very extended", "extended", "normal range", "at the line",
          "at the line", "below the line", "unavailable"]),
        (rules.rs_band("x"), [80., 50., 49., 0., None],
         ["Leadership", "Adequate", "Lagging", "Lagging", "Unavailable"]),
        (text.rs_percentile_text("x"), [99., 80., 79., 49., None],
         ["RS 99 — top 1%", "RS 80 — top 20%", "RS 79 — adequate, not leadership",
          "RS 49 — lagging", "RS unavailable"]),
        (text.fmt_ratio("x"), [1.5, math.inf, None], ["1.50×", "∞", "—"]),
        (text.fmt_pct("x"), [12.34, -3.0, None], ["+12.3%", "-3.0%", "—"]),
        (text.fmt_return("x"), [0.12, None], ["+12.0%", "—"]),
        (text.fmt_inr("x"), [25_000_000.0, 250_000.0, 999.0, None],
         ["₹2.50 Cr", "₹2.50 L", "₹999", "—"]),
        (text.fmt_price("x"), [1234.5, None], ["₹1,234.50", "—"]),
    ]
    for column, items, want in cases:
        assert values(spark, column, items) == want
    assert values(spark, number("x"), ["1.5", "n/a", "nan", "inf", None], "string") == [
        1.5, None, None, math.inf, None]
    assert values(spark, truthy("x"), ["True", " true ", "1", "0", "no", None], "string") == [
        True, True, True, False, False, False]


def test_card_notes(spark):
    rows = snapshot_of(spark, [
        {"Symbol": "wait", "Action": "WATCH", "Stage": STAGE1, "RS_Score": 60.0},
        {"Symbol": "clash", "Action": "SELL", "Stage": "Stage 4 — Declining", "RS_Score": 85.0,
         "Ext_Pct": 89.0},
        {"Symbol": "hair", "Stage": STAGE2, "RS_Score": 30.0, "Ext_Pct": 1.0, "Action": "WAIT"},
    ])
    assert by_symbol(rows.withColumn("x", text.wait_note()), "x")["wait"] == (
        "Stage 1 — the guide requires Stage 2 before buying · RS 60 (needs 80, short by 20)")
    conflict = by_symbol(rows.withColumn("x", text.conflict_note()), "x")
    assert conflict["clash"].startswith("RS 85 in a stage 4 trend.") and conflict["wait"] == ""
    assert conflict["hair"].startswith("The 30-week structure turned up by a hair, but RS 30")
    caution = by_symbol(rows.withColumn("x", text.caution_note()), "x")
    assert caution["clash"].startswith("Extension +89%") and caution["wait"] == ""
    assert "sitting on the 30-week line" in caution["hair"]


def test_signal_rows_keep_an_infinite_ratio_unmet(spark):
    rows = snapshot_of(spark, [{"Symbol": "a", "Stage": STAGE2, "U_D": math.inf, "RS_Score": 80.0,
                                "Volume_Ratio": math.inf, "Near_52W_High": True}])
    found = {r["signal"]: r for r in rows.select(F.inline(text.signal_rows(rows.columns))).collect()}
    assert len(found) == 7
    assert (found["U/D ratio"]["value"], found["U/D ratio"]["status"]) == ("∞", "unmet")
    assert (found["Volume ratio"]["value"], found["Volume ratio"]["status"]) == ("∞", "met")
    assert found["Extension"]["value"] == "—" and found["Extension"]["status"] == "caution"
    short = rows.drop("RS_Line_At_High", "RS_Line_NH_Before_Price")
    items = short.select(F.inline(text.oneil_checklist(short.columns))).collect()
    assert [r["met"] for r in items] == [True, False, False]


def test_corporate_notice(spark):
    rows = spark.createDataFrame(
        [("t", "True", "2026-01-07", "1:2 split or 1:1 bonus"), ("f", "False", "", ""),
         ("n", None, None, None)], "Symbol string, f string, d string, k string")
    got = by_symbol(rows.withColumn("x", text.corporate_action_notice("f", "d", "k")), "x")
    assert got["f"] == "" == got["n"]
    assert "on 2026-01-07" in got["t"] and got["t"].endswith("1:2 split or 1:1 bonus")
