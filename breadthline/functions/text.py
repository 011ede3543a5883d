"""Number formats and the sentences a snapshot row carries, as column expressions.

Sentences are published output, so their wording is a fixed value of the method.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules
from breadthline.functions.numbers import INFINITY, col, finite, flag, truthy

DASH = "—"
JOINER = " · "


def _printf(pattern: str, value: Column) -> Column:
    return F.format_string(pattern, value)


def fmt_number(value, digits: int = 2) -> Column:
    value = finite(value)
    return F.when(value.isNotNull(), _printf(f"%,.{digits}f", value)).otherwise(DASH)


def fmt_pct(value, digits: int = 1, signed: bool = True) -> Column:
    value = finite(value)
    pattern = f"%+.{digits}f%%" if signed else f"%.{digits}f%%"
    return F.when(value.isNotNull(), _printf(pattern, value)).otherwise(DASH)


def fmt_return(value, digits: int = 1) -> Column:
    return fmt_pct(col(value) * 100.0, digits)


def fmt_ratio(value, digits: int = 2) -> Column:
    value = col(value)
    return (
        F.when(value.isNull() | F.isnan(value), DASH)
        .when(F.abs(value) == INFINITY, "∞")
        .otherwise(_printf(f"%.{digits}f×", value))
    )


def fmt_rs(value) -> Column:
    value = finite(value)
    return F.when(value.isNotNull(), _printf("%.0f", value)).otherwise(DASH)


def fmt_price(value) -> Column:
    value = finite(value)
    return F.when(value.isNotNull(), _printf("₹%,.2f", value)).otherwise(DASH)


def fmt_inr(value) -> Column:
    """Rupee amount in crore and lakh."""
    value = finite(value)
    size = F.abs(value)
    return (
        F.when(value.isNull(), DASH)
        .when(size >= 1e7, _printf("₹%,.2f Cr", value / 1e7))
        .when(size >= 1e5, _printf("₹%,.2f L", value / 1e5))
        .otherwise(_printf("₹%,.0f", value))
    )


def fmt_date(value) -> Column:
    return F.coalesce(F.date_format(col(value), "dd MMM yyyy"), F.lit(DASH))


def _signal_number(value: Column, suffix: str = "", digits: int = 2) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value), DASH)
        .when(value == INFINITY, "∞")
        .when(value == -INFINITY, "−∞")
        .otherwise(_printf(f"%,.{digits}f{suffix.replace('%', '%%')}", value))
    )


def _key() -> Column:
    return F.coalesce(rules.stage_key("Stage"), F.lit(""))



def _on(name: str) -> Column:
    return flag(F.col(name))


# --- action reason -------------------------------------------------------------
# SQL text, as in rules.py: this sentence is part of every snapshot row.

_KEY = f"coalesce({rules.STAGE_KEY}, '')"
_RS = "CASE WHEN RS_Score IS NULL THEN 'RS unavailable' ELSE format_string('RS %.0f', RS_Score) END"
_HEAD = f"concat({_KEY}, ' + ', {_RS}, '; ')"
_SHORT = f"format_string('%.0f', {c.RS_LEADER}D - RS_Score)"
_UD = (
    "CASE WHEN U_D IS NULL OR isnan(U_D) OR abs(U_D) = double('Infinity') THEN 'U/D unavailable' "
    "ELSE format_string('U/D %.2f', U_D) END"
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _tail(value: str) -> str:
    return f"concat({_HEAD}, {_text(value)})"


# The one condition a WAIT is waiting for.
_UNMET = f"""CASE
  WHEN {_KEY} <> 'Stage 2' THEN concat(
    {_text("wait because the guide requires Stage 2 before buying, and this is ")}, {_KEY}, '.')
  WHEN Extended_20Pct THEN concat(
    {_text("wait because price is more than 20% above the 30-week line")},
    CASE WHEN Ext_Pct IS NULL THEN '' ELSE format_string(' (currently %+.0f%%)', Ext_Pct) END,
    {_text(" — the guide treats that as poor entry timing, not a failed trend.")})
  WHEN Below_50DMA THEN {_text(
    "wait because the close is below its 50-session average — short-term timing has weakened "
    "even though the 30-week trend is intact.")}
  WHEN RS_Score < {c.RS_ADEQUATE} THEN {_text(
    "wait because relative strength is below 50 — the trend has turned up but the stock still "
    "lags most of the universe.")}
  WHEN RS_Score < {c.RS_LEADER} AND Breakout THEN concat({_text(
    "wait because a breakout without leadership is not an entry: RS needs 80, short by ")},
    {_SHORT}, '.')
  WHEN RS_Score < {c.RS_LEADER} THEN concat(
    {_text("wait because RS is below the 80 leadership band, short by ")}, {_SHORT}, '.')
  ELSE {_text("wait for a clearer entry trigger; no breakout setup is present.")} END"""

ACTION_REASON = f"""CASE
  WHEN Action = 'SELL' AND {_KEY} = 'Stage 4' THEN {_text(
    "Stage 4 takes precedence: the guide requires SELL regardless of RS.")}
  WHEN Action = 'SELL' THEN {_tail("RS below 50 in Stage 3 triggers SELL.")}
  WHEN Action = 'REDUCE' AND {_KEY} = 'Stage 3' THEN concat('Stage 3 with ', {_RS},
    {_text("; the guide requires REDUCE when RS is 50 or higher.")})
  WHEN Action = 'REDUCE' THEN concat({_HEAD}, 'distribution warning (', {_UD}, ') triggers REDUCE.')
  WHEN Action = 'WATCH★' THEN {_tail("high leadership in a basing stage is WATCH★, not a buy.")}
  WHEN Action = 'WATCH' THEN {_tail("adequate RS in a basing stage remains WATCH.")}
  WHEN Action = 'AVOID' THEN {_tail("weak RS in a basing stage is AVOID.")}
  WHEN Action = 'WAIT' THEN concat({_HEAD}, {_UNMET})
  WHEN Action = 'BUY★' THEN {_tail(
    "breakout is confirmed and no guide timing warning is active.")}
  WHEN Action = 'BUY' THEN {_tail("breakout setup is present but confirmation is incomplete.")}
  WHEN Action = 'HOLD' THEN {_tail(
    "trend/leadership is adequate without a stronger entry trigger.")}
  ELSE concat({_KEY}, ' / ', {_RS}, '; no action rule matched.') END"""


def action_reason() -> Column:
    """The decision rule that produced the action, as one sentence."""
    return F.expr(ACTION_REASON)


# --- evidence card ---------------------------------------------------------------

def rs_percentile_text(rs: str | Column = "RS_Score") -> Column:
    rs = finite(rs)
    top = F.greatest(F.lit(1), F.rint(100 - rs).cast("int"))
    return (
        F.when(rs.isNull(), "RS unavailable")
        .when(rs >= c.RS_LEADER, F.format_string("RS %.0f — top %d%%", rs, top))
        .when(rs >= c.RS_ADEQUATE, _printf("RS %.0f — adequate, not leadership", rs))
        .otherwise(_printf("RS %.0f — lagging", rs))
    )


def volume_state() -> Column:
    ud = finite("U_D")
    return (
        F.when(ud.isNull(), "U/D unavailable")
        .when(ud < c.HEAVY_UD, "heavy distribution")
        .when(ud < c.DISTRIBUTION_UD, "distribution warning")
        .when(ud <= c.BREAKOUT_UD, "neutral")
        .when(ud <= c.STRONG_UD, "accumulating")
        .otherwise("strong accumulation")
    )


def wait_note(action: str | Column = "Action") -> Column:
    """Every unmet reason of a WAIT or WATCH; empty for any other action."""
    rs, ext = finite("RS_Score"), finite("Ext_Pct")
    at = F.when(ext.isNotNull(), _printf(" at %+.0f%%", ext)).otherwise("")
    reasons = F.concat_ws(
        JOINER,
        F.when(_key() != "Stage 2",
               F.concat(_key(), F.lit(" — the guide requires Stage 2 before buying"))),
        F.when(rs < c.RS_LEADER,
               F.format_string("RS %.0f (needs 80, short by %.0f)", rs, c.RS_LEADER - rs)),
        F.when(_on("Extended_20Pct"),
               F.concat(F.lit("extended beyond 20% above the 30-week line"), at)),
        F.when(_on("Below_50DMA"), F.lit("below the 50-session average")),
    )
    return F.when(col(action).isin("WAIT", "WATCH", "WATCH★"), reasons).otherwise("")


def conflict_note() -> Column:
    """Where relative strength, stage and volume disagree."""
    key, rs, ud, ext = _key(), finite("RS_Score"), finite("U_D"), finite("Ext_Pct")
    hair = F.when(F.abs(ext) < c.EXTENSION_NEAR, " by a hair").otherwise("")
    return (
        F.when(
            key.isin("Stage 3", "Stage 4") & (rs >= c.RS_LEADER),
            F.concat(_printf("RS %.0f in a ", rs), F.lower(key),
                     F.lit(" trend. A high rank in a falling market means "
                           "least bad, not good. Stage overrides RS absolutely.")))
        .when(
            (key == "Stage 2") & (ud < c.DISTRIBUTION_UD),
            _printf("Price is above a rising 30-week line but U/D is %.2f — volume contradicts "
                    "the price stage. Sellers dominate; Stage 3 may be forming.", ud))
        .when(
            (key == "Stage 2") & (rs < c.RS_ADEQUATE),
            F.concat(F.lit("The 30-week structure turned up"), hair,
                     _printf(", but RS %.0f means the stock still lags most of the universe. "
                             "Stage describes its own trend; RS describes strength against "
                             "everything else.", rs)))
        .otherwise("")
    )


def caution_note() -> Column:
    """The entry risk that the label alone misses."""
    ext, band = finite("Ext_Pct"), rules.extension_band("Ext_Pct")
    return (
        F.when(
            band == "very extended",
            _printf("Extension %+.0f%% — very far above the 30-week line. The signal may be valid "
                    "but the entry is poor. Wait for a pullback toward the line, or size very "
                    "small.", ext))
        .when(
            band == "extended",
            _printf("Extension %+.0f%% — beyond the guide's 20%% comfort band. Do not add here; "
                    "risk back to the line is large.", ext))
        .when(
            band == "at the line",
            _printf("Extension %+.1f%% — price is sitting on the 30-week line. A crossing this "
                    "narrow can reverse on a single session.", ext))
        .otherwise("")
    )


def weinstein_line() -> Column:
    key = _key()
    return F.concat_ws(
        JOINER,
        F.when(key == "Stage 2", "Weinstein: price above a rising 30-week line is Stage 2")
        .when(key == "Stage 4", "Weinstein: never hold Stage 4")
        .when(key == "Stage 3", "Weinstein: Stage 3 is topping — reduce exposure")
        .when(key == "Stage 1", "Weinstein: Stage 1 is basing — wait for the breakout"),
        F.when(_on("Breakout_Confirmed"), "Weinstein: breakout confirmed by volume"),
    )


def oneil_line() -> Column:
    rs = finite("RS_Score")
    return F.concat_ws(
        JOINER,
        F.when(rs >= c.RS_LEADER, "O'Neil: leadership requires RS ≥ 80")
        .when(rs.isNotNull(), "O'Neil: buy leaders, not laggards"),
        F.when(_on("RS_Line_NH_Before_Price"),
               "O'Neil: the relative-strength line turning up before price is the leading tell"),
    )


def minervini_line() -> Column:
    return F.concat_ws(
        JOINER,
        F.when(_on("VCP_Setup"),
               "Minervini: a contracting range on drying volume is the base tightening before a "
               "move"),
        F.when(_on("Trend_Template_Pass"),
               "Minervini: all eight trend-template criteria met (thresholds provisional)"),
    )


def source_line() -> Column:
    lines = F.array(weinstein_line(), oneil_line(), minervini_line())
    return F.array_join(F.filter(lines, lambda x: x != ""), JOINER)


def oneil_checklist(columns: list[str]) -> Column:
    """Leadership criteria as array<struct<label, met>>; line items only when published."""
    items = [
        ("Relative strength 80 or better (leadership)", finite("RS_Score") >= c.RS_LEADER),
        ("Volume 1.5× or more confirms the breakout", finite("Volume_Ratio") > c.BREAKOUT_VOLUME),
        ("Up/down volume 1.3× or more confirms accumulation", finite("U_D") > c.BREAKOUT_UD),
    ]
    if "RS_Line_At_High" in columns:
        items.append(("Relative-strength line at a 52-week high", F.col("RS_Line_At_High")))
    if "RS_Line_NH_Before_Price" in columns:
        items.append(("Relative strength leading price out of the base",
                      F.col("RS_Line_NH_Before_Price")))
    return F.array(*[
        F.struct(F.lit(label).alias("label"), flag(met).alias("met")) for label, met in items
    ])


def checklist_met(items: Column) -> Column:
    return F.size(F.filter(items, lambda x: x["met"]))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def signal_rows(columns: list[str]) -> Column:
    """The threshold table as array<struct<signal, value, threshold, status, note>>."""
    key = _key()
    rs, vol, ud = finite("RS_Score"), F.col("Volume_Ratio"), F.col("U_D")
    ext, slope = finite("Ext_Pct"), finite("MA_30W_Slope_10S_Pct")

    def status(met: Column) -> Column:
        return F.when(flag(met), "met").otherwise("unmet")

    rows = [
        ("Stage", F.when(key == "", DASH).otherwise(key), "Stage 2 required to buy",
         status(key == "Stage 2"),
         F.when(key == "Stage 2", "Price above a rising 30-week line")
         .otherwise("Not an entry condition")),
        ("Relative strength", _signal_number(rs, digits=0), "≥ 80 for leadership",
         status(rs >= c.RS_LEADER), rs_percentile_text(rs)),
        ("Volume ratio", _signal_number(vol, "×"), "≥ 1.5× confirms a breakout",
         status(vol > c.BREAKOUT_VOLUME), F.lit("Latest session against the prior-50 baseline")),
        ("U/D ratio", _signal_number(ud), "≥ 1.3 confirms accumulation",
         F.when(flag(finite("U_D") > c.BREAKOUT_UD), "met")
         .when(flag(ud < c.DISTRIBUTION_UD), "caution").otherwise("unmet"),
         _capital(volume_state())),
        ("Extension", _signal_number(ext, "%", 1), "< 20% is the comfort band",
         F.when(flag((F.abs(ext) < c.EXTENSION_IDEAL) & (F.abs(ext) >= c.EXTENSION_NEAR)), "met")
         .otherwise("caution"),
         _capital(rules.extension_band("Ext_Pct"))),
        ("30-week slope", _signal_number(slope, "%", 2), "> 0% means the line is rising",
         status(slope > 0), F.lit("Change over 10 completed sessions")),
    ]
    if "Near_52W_High" in columns:
        near = _on("Near_52W_High")
        rows.append(("Near the 52-week high", F.when(near, "Yes").otherwise("No"),
                     "within 3% for a breakout setup", status(near),
                     F.lit("Close against the 52-week adjusted high")))
    return F.array(*[
        F.struct(F.lit(signal).alias("signal"), value.alias("value"),
                 F.lit(threshold).alias("threshold"), state.alias("status"), note.alias("note"))
        for signal, value, threshold, state, note in rows
    ])


def corporate_action_notice(flagged: str | Column, when: str | Column,
                            looks_like: str | Column) -> Column:
    """A warning for a row whose history holds a corporate action; empty when clean."""
    when = F.trim(F.coalesce(col(when).cast("string"), F.lit("")))
    kind = F.trim(F.coalesce(col(looks_like).cast("string"), F.lit("")))
    stamp = F.when(when != "", F.concat(F.lit(" on "), when)).otherwise("")
    match = F.when(kind != "", F.concat(F.lit(" Closest match: "), kind)).otherwise("")
    notice = F.concat(
        F.lit("Corporate action in this history"), stamp,
        F.lit(". A single session moved more than a circuit limit allows, so it is not a price "
              "move. The stage, the relative strength and the 52-week figures are all measured "
              "across it, so they describe this price series rather than the business. Nothing "
              "has been corrected."), match)
    return F.when(truthy(flagged), notice).otherwise("")
