"""Classification rules as column expressions, one function per published field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions.numbers import col, count_true, finite, flag, percent_change


def _finite(name: str) -> str:
    return f"(CASE WHEN NOT isnan({name}) AND abs({name}) <> double('Infinity') THEN {name} END)"


def _flag(test: str) -> str:
    return f"coalesce({test}, false)"


def _when_stage(test: str, label: str) -> str:
    return f"WHEN {test} THEN '{c.STAGE_LABELS[label]}'"


# --- rules over published columns, as SQL text ---------------------------------------

STAGE = " ".join([
    "CASE WHEN Close IS NULL OR MA_30W IS NULL OR MA_30W_Slope_10S_Pct IS NULL THEN NULL",
    _when_stage("Close > MA_30W AND MA_30W_Slope_10S_Pct > 0", "Stage 2"),
    _when_stage("Close > MA_30W", "Stage 3"),
    _when_stage("MA_30W_Slope_10S_Pct > 0", "Stage 1"),
    f"ELSE '{c.STAGE_LABELS['Stage 4']}' END",
])
STAGE_KEY = "trim(split(Stage, ' — ', 2)[0])"
NEAR_HIGH = _flag(f"Close >= {c.NEAR_HIGH_FRACTION}D * High_52W")
LINE_AT_HIGH = _flag(
    f"{_finite('RS_Line_High_52W')} <> 0 AND {_finite('RS_Line')} >= "
    f"RS_Line_High_52W * {1.0 - c.LINE_HIGH_TOLERANCE}D"
)
LINE_LEADS_PRICE = _flag(
    f"{LINE_AT_HIGH} AND {_finite('Pct_From_52W_High')} <= {c.LINE_PRICE_GAP_PCT}D"
)
TIMING = {
    "Below_50DMA": _flag("Close < SMA_50"),
    "Ext_Pct": "(try_divide(Close, MA_30W) - 1.0D) * 100.0D",
    "Extended_20Pct": _flag(f"Close > {c.EXTENDED_MULTIPLE}D * MA_30W"),
    "Pct_From_52W_High": "(try_divide(Close, High_52W) - 1.0D) * 100.0D",
}
TREND = {
    "Above_MA_30W": _flag("Close > MA_30W"),
    "Above_MA_10W": _flag("Close > MA_10W"),
    "MA10W_Above_MA30W": _flag("MA_10W > MA_30W"),
    "MA_30W_Rising": _flag("MA_30W_Slope_10S_Pct > 0"),
    "Distribution": _flag(f"U_D < {c.DISTRIBUTION_UD}D"),
    "Heavy_Distribution": _flag(f"U_D < {c.HEAVY_UD}D"),
}
BREAKOUT = _flag(
    f"{STAGE_KEY} = 'Stage 2' AND {NEAR_HIGH} AND Volume_Ratio > {c.BREAKOUT_VOLUME}D"
)
BREAKOUT_CONFIRMED = _flag(f"{BREAKOUT} AND U_D > {c.BREAKOUT_UD}D")
VCP_SETUP = _flag(
    f"{_finite('Contraction_Ratio')} <= {c.CONTRACTION_RATIO_MAX}D "
    f"AND {_finite('Volume_DryUp')} <= {c.DRYUP_MAX}D "
    f"AND VCP_Contractions >= {c.MIN_CONTRACTIONS} AND {STAGE_KEY} = 'Stage 2' "
    f"AND {_finite('Base_Depth_Pct')} <= {c.MAX_BASE_DEPTH_PCT}D"
)
# The eight criteria; a missing input fails only its own.
TEMPLATE = dict(zip(c.TEMPLATE_FLAGS, (_flag(test) for test in (
    "Close > SMA_150 AND Close > SMA_200",
    "SMA_150 > SMA_200",
    "SMA_200_Rising",
    "SMA_50 > SMA_150 AND SMA_50 > SMA_200",
    "Close > SMA_50",
    f"Close >= Low_52W * {c.TEMPLATE_LOW_MULTIPLE}D",
    f"Close >= High_52W * {c.TEMPLATE_HIGH_FRACTION}D",
    f"RS_Score >= {c.TEMPLATE_MIN_RS}D",
)), strict=True))
# How ready a base looks, 0 to 5; defined for Stage 1 only.
STAGE1_READINESS = f"CASE WHEN {STAGE_KEY} = 'Stage 1' THEN double(" + " + ".join(
    f"int({_flag(test)})" for test in (
        f"{_finite('MA_30W_Slope_10S_Pct')} >= {c.READY_SLOPE_MIN}D",
        f"{_finite('RS_Score')} >= {c.READY_RS_MIN}D",
        f"{_finite('Contraction_Ratio')} <= {c.READY_CONTRACTION_MAX}D",
        f"{_finite('Volume_DryUp')} <= {c.READY_DRYUP_MAX}D",
        f"{_finite('Close')} > {_finite('MA_10W')}",
    )
) + ") END"
# One of nine labels; the first rule that applies wins. An infinite U/D is no distribution.
ACTION = f"""CASE
  WHEN {STAGE_KEY} = 'Stage 4' THEN 'SELL'
  WHEN {STAGE_KEY} = 'Stage 3' AND RS_Score < {c.RS_ADEQUATE} THEN 'SELL'
  WHEN {STAGE_KEY} = 'Stage 3' THEN 'REDUCE'
  WHEN {STAGE_KEY} = 'Stage 1' AND RS_Score >= {c.RS_LEADER} THEN 'WATCH★'
  WHEN {STAGE_KEY} = 'Stage 1' AND RS_Score >= {c.RS_ADEQUATE} THEN 'WATCH'
  WHEN {STAGE_KEY} = 'Stage 1' THEN 'AVOID'
  WHEN Stage IS NULL OR {STAGE_KEY} <> 'Stage 2' THEN 'WAIT'
  WHEN {_finite('U_D')} < {c.DISTRIBUTION_UD} THEN 'REDUCE'
  WHEN RS_Score IS NULL OR RS_Score < {c.RS_ADEQUATE} THEN 'WAIT'
  WHEN RS_Score < {c.RS_LEADER} AND Breakout THEN 'WAIT'
  WHEN RS_Score < {c.RS_LEADER} THEN 'HOLD'
  WHEN Extended_20Pct OR Below_50DMA THEN 'WAIT'
  WHEN Breakout_Confirmed THEN 'BUY★'
  WHEN Breakout THEN 'BUY'
  ELSE 'HOLD' END"""


def action() -> Column:
    return F.expr(ACTION)


def stage() -> Column:
    return F.expr(STAGE)


# --- rules over any column ------------------------------------------------------------

def stage_key(label: str | Column) -> Column:
    """'Stage 2 — Advancing' to 'Stage 2'; NULL stays NULL."""
    return F.trim(F.split(col(label), " — ", 2)[0])


def stage_display(label: str | Column) -> Column:
    key = stage_key(label)
    shown = F.lit("Unavailable")
    for name, word in c.STAGE_NAMES.items():
        shown = F.when(key == name, f"{name} · {word}").otherwise(shown)
    return shown


def in_stage(label: str | Column, n: int) -> Column:
    return flag(stage_key(label) == f"Stage {n}")


def ud_class(ud: str | Column) -> Column:
    ud = col(ud)
    return (
        F.when(ud.isNull() | F.isnan(ud), "Undefined")
        .when(ud < c.HEAVY_UD, "Heavy Distribution")
        .when(ud < c.DISTRIBUTION_UD, "Distribution Warning")
        .when(ud <= c.BREAKOUT_UD, "Neutral")
        .when(ud <= c.STRONG_UD, "Accumulating")
        .otherwise("Strong Accumulation")
    )


def extension_band(ext: str | Column = "Ext_Pct") -> Column:
    ext = finite(ext)
    return (
        F.when(ext.isNull(), "unavailable")
        .when(ext >= c.EXTENSION_VERY, "very extended")
        .when(ext >= c.EXTENSION_IDEAL, "extended")
        .when(ext >= c.EXTENSION_NEAR, "normal range")
        .when(ext >= -c.EXTENSION_NEAR, "at the line")
        .otherwise("below the line")
    )


def extension_tone(ext: str | Column = "Ext_Pct") -> Column:
    band = extension_band(ext)
    return (
        F.when(band.isin("very extended", "below the line"), "bad")
        .when(band.isin("extended", "at the line"), "warn")
        .when(band == "normal range", "good")
        .otherwise("neutral")
    )


def rs_band(rs: str | Column = "RS_Score") -> Column:
    rs = finite(rs)
    return (
        F.when(rs >= c.RS_LEADER, "Leadership")
        .when(rs >= c.RS_ADEQUATE, "Adequate")
        .when(rs >= 0, "Lagging")
        .otherwise("Unavailable")
    )


def regime(pct: str | Column) -> Column:
    pct = finite(pct)
    return (
        F.when(pct >= c.REGIME_BROAD, "Broad")
        .when(pct >= c.REGIME_MIXED, "Mixed")
        .when(pct >= 0, "Narrow")
        .otherwise("Unavailable")
    )


def range_position(low: Column, close: Column, high: Column) -> Column:
    """Where the close sits in its range, 0 to 100; NULL when the range is not bounded."""
    low, close, high = finite(low), finite(close), finite(high)
    raw = F.try_divide(close - low, high - low) * 100.0
    return F.when((high > low) & close.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def return_to_line() -> Column:
    """The move, in percent, that would bring the close back to the 30-week line."""
    return percent_change(finite("MA_30W"), finite("Close"))


def setup_evidence() -> Column:
    return count_true([
        F.col("Trend_Template_Pass"),
        F.col("RS_Line_NH_Before_Price"),
        F.col("VCP_Setup"),
        F.col("Stage1_Readiness") >= 4,
    ])
