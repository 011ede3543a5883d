"""Registered queries against their SQL on the smallest tables.

A sample by default; all of them with ORACLE_ALL=1 (tools/check.py does the same
at any scale).
"""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "bars_with_gaps", "maturing", "liquidity_admission", "universe_merge", "research_supplier",
    "moving_averages", "breadth_history", "transition_counts", "corporate_action_moves",
    "forward_returns", "exact_median_price", "spans_discontinuity",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(con, spark, name):
    good, note = check.compare(con, spark, FOLDER, name)
    assert good, note


def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["Symbol", "Industry", "RS_Blend", "RS_Score"] and rows.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
