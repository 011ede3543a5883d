"""The shaped variant takes every branch: a label, list or reason without a row fails here."""

from __future__ import annotations

import pytest

from breadthline import config as c
from breadthline.operators import boundary, record, screens
from breadthline.session import land
from verification import QUERIES
from verification.inputs import Inputs
from verification.q_indicators import full

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    snapshot = land(full(Inputs(spark, FOLDER, "shaped")), "shaped")
    return snapshot, snapshot.collect()


def test_every_label(rows):
    _, found = rows
    actions = {r["Action"] for r in found}
    assert actions == {"BUY★", "BUY", "HOLD", "WAIT", "REDUCE", "SELL", "WATCH★", "WATCH", "AVOID"}
    stages = {r["Stage"] for r in found}
    assert stages == {*c.STAGE_LABELS.values(), None}


@pytest.mark.parametrize("name", [
    "Near_52W_High", "Breakout", "Breakout_Confirmed", "RS_Line_At_High", "RS_Line_NH_Before_Price",
    "VCP_Setup", "Trend_Template_Pass", "Extended_20Pct", "Below_50DMA", "Distribution",
    "Heavy_Distribution", "Liquid_UI_Filter", *c.TEMPLATE_FLAGS])
def test_every_flag_both_ways(rows, name):
    assert {r[name] for r in rows[1]} == {True, False}


def test_every_preset_setup_and_cohort(rows):
    snapshot, _ = rows
    presets = {r["preset"] for r in screens.preset_members(snapshot).collect()}
    assert presets == set(screens.presets())
    groups = {r["group"] for r in screens.setup_members(snapshot).collect()}
    assert groups == set(screens.setup_groups())
    cohorts = {r["cohort"] for r in record.cohort_members(snapshot).collect()}
    assert cohorts == set(c.COHORTS)
    for name in screens.shelves():
        assert screens.shelf(snapshot, name).count() > 0, name
    for name, listed in screens.briefing(snapshot).items():
        assert listed.count() > 0, name
    assert screens.leader_board(snapshot).count() >= 5
    assert screens.screen(snapshot, liquid_only=True).count() > 0


def test_closed_sessions_and_every_reason(spark):
    closed = [r["date"] for r in QUERIES["shaped_session_trading"].run(spark, FOLDER).collect()
              if r["closed"]]
    assert len(closed) == 2
    reasons = [r["reason"] for r in QUERIES["shaped_audit_excluded"].run(spark, FOLDER).collect()]
    assert boundary.DUPLICATES in reasons and "the provider returned no history" in reasons
    assert any("its latest is" in r for r in reasons)
    doubled = QUERIES["audit_excluded"].run(spark, FOLDER).collect()
    assert boundary.DUPLICATES in {r["reason"] for r in doubled}


def test_corporate_actions_at_production_thresholds(spark):
    flags = QUERIES["shaped_corporate_action_flags"].run(spark, FOLDER).collect()
    hit = [r for r in flags if r["Corporate_Action"]]
    assert len(flags) > 25 and [r["Symbol"] for r in hit] == ["SHAPE_16"]
    assert hit[0]["Corporate_Action_Date"] and hit[0]["Corporate_Action_Kind"]
