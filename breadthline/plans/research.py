"""The research snapshot: one row per symbol at one shared session."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules, text
from breadthline.operators import boundary as b
from breadthline.operators.indicators import symbol_indicators
from breadthline.operators.ranking import rs_score
from breadthline.session import land


def finalize(rows: DataFrame) -> DataFrame:
    """Fields that need the whole cross-section, or the score made from it."""
    scored = rs_score(rows).selectExpr(
        "*",
        f"coalesce(AvgValue20 > {c.LIQUID_VALUE}D, false) AS Liquid_UI_Filter",
        f"coalesce(RS_Score >= {c.RS_ADEQUATE}D, false) AS RS_Not_Lagging",
        f"{rules.LINE_LEADS_PRICE} AS RS_Line_NH_Before_Price",
        f"{rules.STAGE1_READINESS} AS Stage1_Readiness",
        *[f"{test} AS {name}" for name, test in rules.TEMPLATE.items()],
    )
    score = " + ".join(f"int({n})" for n in c.TEMPLATE_FLAGS)
    return scored.selectExpr(
        "*",
        " + ".join(f"int({n})" for n in c.HEALTH_FLAGS) + " AS Trend_Health",
        f"{score} AS Trend_Template_Score",
        f"{score} = {len(c.TEMPLATE_FLAGS)} AS Trend_Template_Pass",
    )


def with_actions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Action", rules.action()).withColumn(
        "Action_Reason", text.action_reason()
    )


def with_universe(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Names and industries by left join; one row per symbol on both sides."""
    named = universe.select(*[
        F.col(f"`{n}`") for n in ("Symbol", "Company Name", "Industry", "Series")
        if n in universe.columns
    ])
    return rows.join(named, "Symbol", "left")


def measured_rows(
    bars: DataFrame, boundary: dt.date, benchmark: DataFrame | None = None,
    min_sessions: int = c.MIN_RANGE_SESSIONS,
) -> DataFrame:
    """Per-symbol fields of the symbols that have a close at the boundary."""
    rows = symbol_indicators(b.rows_until(bars, boundary), benchmark, min_sessions)
    return b.at_boundary(rows, boundary)


def research(
    bars: DataFrame, universe: DataFrame | None, boundary: dt.date,
    benchmark: DataFrame | None = None, min_sessions: int = c.MIN_RANGE_SESSIONS,
) -> DataFrame:
    """The full snapshot.

    The symbol rows are written once before the ranking: the ranking reads them
    several times, and each of these reads would otherwise go back to the bars.
    """
    if universe is not None:
        bars = bars.join(
            universe.select(F.col("Symbol").alias("symbol")), "symbol", "left_semi"
        )
    rows = land(measured_rows(bars, boundary, benchmark, min_sessions), "symbols")
    rows = finalize(rows.drop("Range_Blocks"))
    if universe is not None:
        rows = with_universe(rows, universe)
    return with_actions(rows)


def own_session_research(
    bars: DataFrame, decision: dt.date, benchmark: DataFrame | None = None,
    min_sessions: int = c.MIN_RANGE_SESSIONS,
) -> DataFrame:
    """The strict variant: every symbol at its own last session before the decision."""
    rows = symbol_indicators(b.rows_until_own_session(bars, decision), benchmark, min_sessions)
    return with_actions(finalize(land(rows, "symbols").drop("Range_Blocks")))


def texts(rows: DataFrame) -> DataFrame:
    """The sentences of the evidence card, one column each."""
    columns: dict[str, Column] = {
        "RS_Text": text.rs_percentile_text(),
        "Extension_Band": rules.extension_band(),
        "Volume_State": text.volume_state(),
        "Wait_Note": text.wait_note(),
        "Conflict_Note": text.conflict_note(),
        "Caution_Note": text.caution_note(),
        "Weinstein_Line": text.weinstein_line(),
        "Oneil_Line": text.oneil_line(),
        "Minervini_Line": text.minervini_line(),
        "Source_Line": text.source_line(),
    }
    return rows.withColumns(columns)
