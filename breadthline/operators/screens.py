"""Named filters, sorts, pages and shelves over a snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules
from breadthline.functions.numbers import flag, number
from breadthline.operators.ranking import top


def _is(name: str) -> Column:
    return flag(F.col(name))


def presets() -> dict[str, Column]:
    """The one-click screens; each composes published fields only."""
    return {
        "Buy candidates": (
            rules.in_stage("Stage", 2) & flag(number("RS_Score") >= c.RS_LEADER)
            & ~_is("Extended_20Pct") & ~_is("Below_50DMA")
        ),
        "Coiling": _is("VCP_Setup"),
        "RS leading price": _is("RS_Line_NH_Before_Price"),
        "Template pass": _is("Trend_Template_Pass"),
        "Exit now": rules.in_stage("Stage", 4)
        | (rules.in_stage("Stage", 3) & _is("Distribution")),
    }


def preset(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter(presets()[name])


def preset_members(rows: DataFrame) -> DataFrame:
    """Every preset's members in one pass."""
    hits = F.array(*[F.when(test, F.lit(name)) for name, test in presets().items()])
    return rows.select("Symbol", "RS_Score", F.explode(F.array_compact(hits)).alias("preset"))


def screen(
    rows: DataFrame, *, industry: str | None = None, stage: str | None = None,
    actions: Sequence[str] = (), rs_low: float = 1, rs_high: float = 99,
    liquid_only: bool = False, search: str | None = None,
) -> DataFrame:
    """The ad-hoc filters; a row without a score never passes the RS band."""
    out = rows.filter(number("RS_Score").between(rs_low, rs_high))
    if industry:
        out = out.filter(F.col("Industry") == industry)
    if stage:
        out = out.filter(rules.stage_key("Stage") == stage)
    if actions:
        out = out.filter(F.col("Action").isin(*actions))
    if liquid_only and "Liquid_UI_Filter" in rows.columns:
        out = out.filter(_is("Liquid_UI_Filter"))
    if search and search.strip():
        names = [n for n in ("Symbol", "Industry", "Company Name") if n in rows.columns]
        text = F.upper(F.concat_ws(" ", *[F.col(f"`{n}`").cast("string") for n in names]))
        out = out.filter(text.contains(search.strip().upper()))
    return out


def _order(column: str, ascending: bool) -> Column:
    return F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)


def ordered(rows: DataFrame, sort: str, sorts: dict = c.SCREENER_SORTS) -> DataFrame:
    column, ascending = sorts[sort]
    if column not in rows.columns:
        return rows
    name = "Symbol" if "Symbol" in rows.columns else "Industry"
    return rows.orderBy(_order(column, ascending), F.asc(name))


def page(rows: DataFrame, sort: str, number_: int = 1, size: int = c.PAGE_SIZE,
         sorts: dict = c.SCREENER_SORTS) -> DataFrame:
    """One page of the sorted rows; pages count from 1."""
    return ordered(rows, sort, sorts).offset((number_ - 1) * size).limit(size)


def industries(board: DataFrame, sort: str = "Median RS (high to low)") -> DataFrame:
    """The industry board in one of its orders."""
    return ordered(board, sort, c.INDUSTRY_SORTS)


def page_count(rows: DataFrame, size: int = c.PAGE_SIZE) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).alias("pages")
    )


# --- setups --------------------------------------------------------------------

def setup_groups() -> dict[str, Column]:
    return {
        "Trend template": _is("Trend_Template_Pass"),
        "RS leading price": _is("RS_Line_NH_Before_Price"),
        "Contracting base": _is("VCP_Setup"),
        "Stage 1 ready": flag(number("Stage1_Readiness") >= 4),
        "Stacked (2+)": F.col("Setup_Evidence") >= 2,
        "All": F.lit(True),
    }


def with_setup_evidence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("Setup_Evidence", rules.setup_evidence())


def setups(rows: DataFrame, group: str = "Trend template", industry: str | None = None,
           liquid_only: bool = True, sort: str = "Evidence (most first)") -> DataFrame:
    out = with_setup_evidence(rows)
    if liquid_only and "Liquid_UI_Filter" in rows.columns:
        out = out.filter(_is("Liquid_UI_Filter"))
    if industry:
        out = out.filter(F.col("Industry") == industry)
    return ordered(out.filter(setup_groups()[group]), sort, c.SETUP_SORTS)


def setup_members(rows: DataFrame) -> DataFrame:
    hits = F.array(*[F.when(test, F.lit(name)) for name, test in setup_groups().items()])
    return with_setup_evidence(rows).select(
        "Symbol", "Setup_Evidence", F.explode(F.array_compact(hits)).alias("group")
    )


# --- shelves ---------------------------------------------------------------------

def shelves() -> dict[str, Column]:
    """Where names sit today, best RS first."""
    stage2 = rules.in_stage("Stage", 2)
    return {
        "RS leadership": flag(F.col("RS_Score") >= c.RS_LEADER),
        "Breakout setups": stage2 & _is("Breakout") & ~_is("Breakout_Confirmed"),
        "Confirmed breakouts": _is("Breakout_Confirmed"),
        "Timing warnings in leadership": stage2 & flag(F.col("RS_Score") >= c.RS_LEADER)
        & (_is("Extended_20Pct") | _is("Below_50DMA")),
    }


def shelf(rows: DataFrame, name: str, head: int = 14) -> DataFrame:
    return top(rows.filter(shelves()[name]), head, F.desc_nulls_last("RS_Score"))


def briefing(rows: DataFrame) -> dict[str, DataFrame]:
    """The short lists of the briefing page."""
    best = F.desc_nulls_last("RS_Score")
    weak = flag(rules.stage_key("Stage").isin("Stage 3", "Stage 4"))
    return {
        "confirmed": top(rows.filter(_is("Breakout_Confirmed")), 8, best),
        "stage2_leaders": top(rows.filter(rules.in_stage("Stage", 2)), 6, best),
        "weak": top(rows.filter(weak), 6, F.asc_nulls_last("RS_Score")),
    }


def strongest(rows: DataFrame, k: int = 25) -> DataFrame:
    return top(rows, k, F.desc_nulls_last("R3M"))


def weakest(rows: DataFrame, k: int = 25) -> DataFrame:
    return top(rows, k, F.asc_nulls_last("R3M"))


def leader_board(rows: DataFrame, k: int = 15) -> DataFrame:
    """Names to hold or buy by RS, confirmed breakouts first among equals."""
    return top(
        rows.filter(F.col("Action").isin("BUY★", "BUY", "HOLD")), k,
        F.desc_nulls_last("RS_Score"), F.desc_nulls_last("Breakout_Confirmed"),
    )


def setup_board(rows: DataFrame, k: int = 50) -> DataFrame:
    return top(rows, k, F.desc_nulls_last("Breakout_Confirmed"), F.desc_nulls_last("RS_Score"),
               F.desc_nulls_last("R3M"))


def top_symbol(rows: DataFrame) -> DataFrame:
    """The default selection: the highest score, first symbol on a tie."""
    return top(rows.filter(F.col("Symbol").isNotNull()), 1, F.desc_nulls_last("RS_Score")).select(
        "Symbol", "RS_Score"
    )


def industry_members(rows: DataFrame, industry: str) -> DataFrame:
    return rows.filter(F.col("Industry") == industry).orderBy(
        F.desc_nulls_last("RS_Score"), F.asc("Symbol")
    )


def industry_stage_counts(rows: DataFrame) -> DataFrame:
    """Stage posture of every industry, so that a drill-down is a filter."""
    return rows.groupBy("Industry").agg(
        F.count(F.lit(1)).alias("Stocks"),
        *[F.count_if(rules.in_stage("Stage", n)).alias(f"Stage_{n}") for n in range(1, 5)],
    )


def returns_with_cost(rows: DataFrame) -> DataFrame:
    """Each window's return beside the deepest fall inside the same window."""
    pairs = F.array(*[
        F.struct(
            F.lit(f"{m}M").alias("window"),
            F.col(f"R{m}M").alias("return"), F.col(f"MaxDD_{m}M").alias("drawdown"),
        )
        for m in c.RETURN_MONTHS
    ])
    return rows.select("Symbol", F.inline(pairs))
