"""Per-symbol indicators, the whole snapshot, and its rule columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from breadthline.functions import rules, text
from breadthline.operators import indicators as ind
from breadthline.operators import ranking
from breadthline.plans import research as plans
from verification import oracle_base as o
from verification.inputs import Inputs
from verification.registry import register


def measured(i: Inputs):
    return plans.measured_rows(
        i.landed_bars(), i.boundary(), i.landed_benchmark(), i.variant.min_sessions
    )


def full(i: Inputs):
    return plans.research(
        i.landed_bars(), i.universe(), i.boundary(), i.landed_benchmark(), i.variant.min_sessions
    )


def from_snapshot(name: str, columns: str, variant: str = "settled", build=measured):
    """A query that shows some columns of the snapshot."""
    return register(name, columns, variant, o.snapshot(variant), "research")(build)


FIELDS = """Symbol, Date:d, Close:f, R3M:f, R6M:f, R9M:f, R12M:f, RS_Blend:f, MaxDD_3M:f,
MaxDD_6M:f, MaxDD_9M:f, MaxDD_12M:f, Up_Days_Pct_6M:f, MA_30W:f, MA_30W_Slope_10S_Pct:f, Stage,
MA_10W:f, High_52W:f, Near_52W_High, Low_52W:f, Volume_Ratio:f, U_D:f, AvgValue20:f, SMA_50:f,
Below_50DMA, Ext_Pct:f, Extended_20Pct, Pct_From_52W_High:f, Above_MA_30W, Above_MA_10W,
MA10W_Above_MA30W, MA_30W_Rising, Distribution, Heavy_Distribution, Breakout, Breakout_Confirmed,
SMA_150:f, SMA_200:f, SMA_200_Rising, ATR_Pct:f, VCP_Contractions:i, Contraction_Ratio:f,
Base_Depth_Pct:f, Volume_DryUp:f, VCP_Setup, VCP_Pivot:f, Pct_To_Pivot:f, RS_Line:f,
RS_Line_High_52W:f, RS_Line_At_High, RS_Score:f, Liquid_UI_Filter, RS_Not_Lagging, Trend_Health:i,
TT1_Above_150_200, TT2_150_Above_200, TT3_200_Rising, TT4_50_Above_150_200, TT5_Above_50,
TT6_Above_52W_Low, TT7_Near_52W_High, TT8_RS, Trend_Template_Score:i, Trend_Template_Pass,
RS_Line_NH_Before_Price, Stage1_Readiness:f, Company Name, Industry, Series, Action"""

from_snapshot("research", FIELDS, "nation", full)
from_snapshot("research_with_gaps", FIELDS, "settled", full)
from_snapshot("research_supplier", FIELDS, "supplier", full)

from_snapshot("rs_returns", "Symbol, Date:d, Close:f, R3M:f, R6M:f, R9M:f, R12M:f, RS_Blend:f")
from_snapshot("max_drawdown", "Symbol, MaxDD_3M:f, MaxDD_6M:f, MaxDD_9M:f, MaxDD_12M:f")
from_snapshot("up_days", "Symbol, Up_Days_Pct_6M:f")
from_snapshot("stage", "Symbol, Close:f, MA_30W:f, MA_30W_Slope_10S_Pct:f, MA_10W:f, Stage")
from_snapshot("high_low_52w", "Symbol, High_52W:f, Low_52W:f, Near_52W_High", "supplier")
from_snapshot("volume_ratio", "Symbol, Volume_Ratio:f")
from_snapshot("average_value", "Symbol, AvgValue20:f")
from_snapshot("sma_stack", "Symbol, SMA_50:f, SMA_150:f, SMA_200:f, SMA_200_Rising")
from_snapshot("rs_line", "Symbol, RS_Line:f, RS_Line_High_52W:f, RS_Line_At_High", "supplier")
from_snapshot("atr_pct", "Symbol, ATR_Pct:f")
from_snapshot("vcp_base", """Symbol, VCP_Contractions:i, Contraction_Ratio:f, Base_Depth_Pct:f,
  Volume_DryUp:f, VCP_Setup, VCP_Pivot:f, Pct_To_Pivot:f""")
from_snapshot("timing", """Symbol, SMA_50:f, Below_50DMA, Ext_Pct:f, Extended_20Pct,
  Pct_From_52W_High:f""", "nation")
from_snapshot("trend_flags", """Symbol, Above_MA_30W, Above_MA_10W, MA10W_Above_MA30W,
  MA_30W_Rising, Distribution, Heavy_Distribution, Breakout, Breakout_Confirmed""", "nation")
from_snapshot("trend_template", """Symbol, TT1_Above_150_200, TT2_150_Above_200, TT3_200_Rising,
  TT4_50_Above_150_200, TT5_Above_50, TT6_Above_52W_Low, TT7_Near_52W_High, TT8_RS,
  Trend_Template_Score:i, Trend_Template_Pass""", "supplier", full)
from_snapshot("trend_health", """Symbol, RS_Score:f, RS_Not_Lagging, Liquid_UI_Filter,
  Trend_Health:i""", "supplier", full)
from_snapshot("stage1_readiness", "Symbol, Stage, RS_Score:f, Stage1_Readiness:f", "supplier", full)
from_snapshot("rs_line_leads_price", """Symbol, RS_Line_At_High, Pct_From_52W_High:f,
  RS_Line_NH_Before_Price""", "supplier", full)
from_snapshot("action", "Symbol, Stage, RS_Score:f, U_D:f, Action", "supplier", full)


@register(
    "rs_score", "Symbol, Industry, RS_Blend:f, RS_Score:f", "nation",
    f"""{o.snapshot('nation')}, result AS (
      SELECT * FROM research)""")
def _(i):
    rows = i.landed_bars()
    blends = plans.measured_rows(rows, i.boundary()).select("Symbol", "RS_Blend")
    scored = ranking.rs_score(plans.land(blends, "blends"))
    return plans.with_universe(scored, i.universe())


@register(
    "rs_score_all_parts", "part, score:f", "nation",
    """WITH totals AS (
      SELECT l_partkey AS part, sum(l_quantity) AS blend FROM lineitem GROUP BY 1),
    result AS (
      SELECT part, round_even(rank() OVER (ORDER BY blend) / count(*) OVER () * 98.0 + 1.0, 0) AS score
      FROM totals)""")
def _(i):
    totals = i.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.sum("l_quantity").alias("RS_Blend")
    )
    return ranking.rs_score(plans.land(totals, "totals"), name="score")


@register(
    "up_down_ratio", "Symbol, U_D:f, class", "settled",
    f"""{o.snapshot('settled')}, result AS (
      SELECT "Symbol", "U_D", CASE WHEN "U_D" IS NULL THEN 'Undefined'
        WHEN "U_D" < 0.6 THEN 'Heavy Distribution' WHEN "U_D" < 0.7 THEN 'Distribution Warning'
        WHEN "U_D" <= 1.3 THEN 'Neutral' WHEN "U_D" <= 1.5 THEN 'Accumulating'
        ELSE 'Strong Accumulation' END AS class FROM research)""")
def _(i):
    return measured(i).withColumn("class", rules.ud_class("U_D"))


@register(
    "range_blocks", "Symbol, block:i, range_pct:f", "settled",
    f"""{o.snapshot('settled')}, result AS (
      SELECT "Symbol", unnest([0, 1, 2, 3, 4]) AS block, unnest([b0, b1, b2, b3, b4]) AS range_pct
      FROM research WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL
        AND b4 IS NOT NULL)""")
def _(i):
    return measured(i).select("Symbol", F.posexplode("Range_Blocks").alias("block", "range_pct"))


def ma_sql(variant: str) -> str:
    """Averages at every session: the start session by an as-of join, then a join of the rows."""
    return f"""WITH {o.bars(variant)}, c AS (SELECT * FROM bars WHERE close IS NOT NULL),
    s10 AS (SELECT a.symbol, a.date, b.date AS s FROM c a ASOF JOIN c b
      ON a.symbol = b.symbol AND a.date - 70 >= b.date),
    s30 AS (SELECT a.symbol, a.date, b.date AS s FROM c a ASOF JOIN c b
      ON a.symbol = b.symbol AND a.date - 210 >= b.date),
    m10 AS (SELECT s.symbol, s.date, avg(c.close) AS ma_10w FROM s10 s JOIN c
      ON c.symbol = s.symbol AND c.date BETWEEN s.s AND s.date GROUP BY 1, 2),
    m30 AS (SELECT s.symbol, s.date, avg(c.close) AS ma_30w FROM s30 s JOIN c
      ON c.symbol = s.symbol AND c.date BETWEEN s.s AND s.date GROUP BY 1, 2),
    ma AS (SELECT bars.*, ma_10w, ma_30w, row_number() OVER (
        PARTITION BY bars.symbol ORDER BY bars.date DESC) AS recency
      FROM bars LEFT JOIN m10 USING (symbol, date) LEFT JOIN m30 USING (symbol, date))"""


@register("moving_averages", "symbol, date:d, close:f, ma_10w:f, ma_30w:f", "settled",
          ma_sql("settled"), "ma")
def _(i):
    return ind.moving_averages(i.bars())


@register("trend_frame", "symbol, date:d, close:f, ma_10w:f, ma_30w:f, volume:f", "settled",
          f"{ma_sql('settled')}, result AS (SELECT * FROM ma WHERE recency <= 420)")
def _(i):
    return ind.trend_frame(i.bars())


@register(
    "chart_series", "symbol, date:d, close:f, ma_10w:f, ma_30w:f", "settled",
    f"""{ma_sql('settled')}, result AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k,
        count(*) OVER (PARTITION BY symbol) AS n FROM ma WHERE close IS NOT NULL)
      WHERE k <= 260 AND n >= 40)""")
def _(i):
    return ind.chart_series(i.bars())


@register(
    "candle_series", "symbol, date:d, high:f, low:f, close:f, ma_30w:f", "settled",
    f"""WITH {o.bars('settled')}, t AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars)
      WHERE k <= 420),
    c AS (SELECT * FROM t WHERE close IS NOT NULL),
    s30 AS (SELECT a.symbol, a.date, b.date AS s FROM c a ASOF JOIN c b
      ON a.symbol = b.symbol AND a.date - 210 >= b.date),
    m30 AS (SELECT s.symbol, s.date, avg(c.close) AS ma_30w FROM s30 s JOIN c
      ON c.symbol = s.symbol AND c.date BETWEEN s.s AND s.date GROUP BY 1, 2),
    result AS (SELECT t.symbol, t.date, CASE WHEN close IS NOT NULL THEN high END AS high,
        CASE WHEN close IS NOT NULL THEN low END AS low, close, ma_30w
      FROM t LEFT JOIN m30 USING (symbol, date))""")
def _(i):
    return ind.candle_series(i.bars())


@register(
    "session_average_50", "symbol, date:d, close:f, sma_50:f", "settled",
    f"""WITH {o.bars('settled')}, result AS (
      SELECT symbol, date, close, CASE WHEN count(*) OVER w = 50 THEN avg(close) OVER w END AS sma_50
      FROM bars WHERE close IS NOT NULL
      WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))""")
def _(i):
    return ind.session_average(i.bars(), 50)


@register(
    "rs_line_series", "symbol, date:d, line:f", "settled",
    f"""WITH {o.bars('settled')}, {o.BENCH}, result AS (
      SELECT symbol, date, bars.close / bench.close AS line FROM bars JOIN bench USING (date)
      WHERE bars.close IS NOT NULL)""")
def _(i):
    return ind.with_benchmark(i.bars(), i.benchmark()).filter(F.col("line").isNotNull())


@register(
    "true_range", "symbol, date:d, true_range:f", "settled",
    f"""WITH {o.bars('settled')}, p AS (
      SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM bars),
    result AS (SELECT symbol, date, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM p)""")
def _(i):
    return ind.session_facts(ind.with_benchmark(i.bars(), None))


# --- rules and texts over the snapshot ---------------------------------------------

RS = """CASE WHEN "RS_Score" IS NULL THEN 'RS unavailable' ELSE printf('RS %.0f', "RS_Score") END"""
KEY = "coalesce(sk, '')"
SHORT = """printf('%.0f', 80.0 - "RS_Score")"""

REASON = f"""CASE "Action"
  WHEN 'SELL' THEN CASE WHEN sk = 'Stage 4'
    THEN 'Stage 4 takes precedence: the guide requires SELL regardless of RS.'
    ELSE {KEY} || ' + ' || {RS} || '; RS below 50 in Stage 3 triggers SELL.' END
  WHEN 'REDUCE' THEN CASE WHEN sk = 'Stage 3'
    THEN 'Stage 3 with ' || {RS} || '; the guide requires REDUCE when RS is 50 or higher.'
    ELSE {KEY} || ' + ' || {RS} || '; distribution warning (' || CASE WHEN isinf("U_D") OR "U_D" IS NULL
      THEN 'U/D unavailable' ELSE printf('U/D %.2f', "U_D") END || ') triggers REDUCE.' END
  WHEN 'WATCH★' THEN {KEY} || ' + ' || {RS} || '; high leadership in a basing stage is WATCH★, not a buy.'
  WHEN 'WATCH' THEN {KEY} || ' + ' || {RS} || '; adequate RS in a basing stage remains WATCH.'
  WHEN 'AVOID' THEN {KEY} || ' + ' || {RS} || '; weak RS in a basing stage is AVOID.'
  WHEN 'BUY★' THEN {KEY} || ' + ' || {RS} || '; breakout is confirmed and no guide timing warning is active.'
  WHEN 'BUY' THEN {KEY} || ' + ' || {RS} || '; breakout setup is present but confirmation is incomplete.'
  WHEN 'HOLD' THEN {KEY} || ' + ' || {RS} || '; trend/leadership is adequate without a stronger entry trigger.'
  ELSE {KEY} || ' + ' || {RS} || '; ' || CASE
    WHEN {KEY} <> 'Stage 2' THEN 'wait because the guide requires Stage 2 before buying, and this is ' || {KEY} || '.'
    WHEN "Extended_20Pct" THEN 'wait because price is more than 20% above the 30-week line'
      || printf(' (currently %+.0f%%)', "Ext_Pct")
      || ' — the guide treats that as poor entry timing, not a failed trend.'
    WHEN "Below_50DMA" THEN 'wait because the close is below its 50-session average — short-term timing has weakened even though the 30-week trend is intact.'
    WHEN "RS_Score" < 50 THEN 'wait because relative strength is below 50 — the trend has turned up but the stock still lags most of the universe.'
    WHEN "RS_Score" < 80 AND "Breakout" THEN 'wait because a breakout without leadership is not an entry: RS needs 80, short by ' || {SHORT} || '.'
    WHEN "RS_Score" < 80 THEN 'wait because RS is below the 80 leadership band, short by ' || {SHORT} || '.'
    ELSE 'wait for a clearer entry trigger; no breakout setup is present.' END END"""


@register("action_reason", "Symbol, Action, Action_Reason", "supplier",
          f"""{o.snapshot('supplier')}, result AS (
            SELECT "Symbol", "Action", {REASON} AS "Action_Reason" FROM research)""")
def _(i):
    return full(i)


BAND = """CASE WHEN "Ext_Pct" IS NULL THEN 'unavailable' WHEN "Ext_Pct" >= 75 THEN 'very extended'
  WHEN "Ext_Pct" >= 20 THEN 'extended' WHEN "Ext_Pct" >= 2 THEN 'normal range'
  WHEN "Ext_Pct" >= -2 THEN 'at the line' ELSE 'below the line' END"""
TOP = """CASE WHEN "RS_Score" IS NULL THEN 'RS unavailable'
  WHEN "RS_Score" >= 80 THEN printf('RS %.0f — top %d%%', "RS_Score", greatest(1, CAST(100 - "RS_Score" AS INT)))
  WHEN "RS_Score" >= 50 THEN printf('RS %.0f — adequate, not leadership', "RS_Score")
  ELSE printf('RS %.0f — lagging', "RS_Score") END"""
VOLUME = """CASE WHEN "U_D" IS NULL OR isinf("U_D") THEN 'U/D unavailable' WHEN "U_D" < 0.6 THEN 'heavy distribution'
  WHEN "U_D" < 0.7 THEN 'distribution warning' WHEN "U_D" <= 1.3 THEN 'neutral'
  WHEN "U_D" <= 1.5 THEN 'accumulating' ELSE 'strong accumulation' END"""
WAIT = f"""CASE WHEN "Action" IN ('WAIT', 'WATCH', 'WATCH★') THEN concat_ws(' · ',
  CASE WHEN {KEY} <> 'Stage 2' THEN {KEY} || ' — the guide requires Stage 2 before buying' END,
  CASE WHEN "RS_Score" < 80 THEN printf('RS %.0f (needs 80, short by %.0f)', "RS_Score", 80 - "RS_Score") END,
  CASE WHEN "Extended_20Pct" THEN 'extended beyond 20% above the 30-week line' || printf(' at %+.0f%%', "Ext_Pct") END,
  CASE WHEN "Below_50DMA" THEN 'below the 50-session average' END) ELSE '' END"""
CONFLICT = f"""CASE
  WHEN sk IN ('Stage 3', 'Stage 4') AND "RS_Score" >= 80 THEN printf('RS %.0f in a ', "RS_Score") || lower(sk)
    || ' trend. A high rank in a falling market means least bad, not good. Stage overrides RS absolutely.'
  WHEN sk = 'Stage 2' AND "U_D" < 0.7 THEN printf('Price is above a rising 30-week line but U/D is %.2f — volume contradicts the price stage. Sellers dominate; Stage 3 may be forming.', "U_D")
  WHEN sk = 'Stage 2' AND "RS_Score" < 50 THEN 'The 30-week structure turned up' || CASE WHEN abs("Ext_Pct") < 2 THEN ' by a hair' ELSE '' END
    || printf(', but RS %.0f means the stock still lags most of the universe. Stage describes its own trend; RS describes strength against everything else.', "RS_Score")
  ELSE '' END"""
CAUTION = f"""CASE {BAND}
  WHEN 'very extended' THEN printf('Extension %+.0f%% — very far above the 30-week line. The signal may be valid but the entry is poor. Wait for a pullback toward the line, or size very small.', "Ext_Pct")
  WHEN 'extended' THEN printf('Extension %+.0f%% — beyond the guide''s 20%% comfort band. Do not add here; risk back to the line is large.', "Ext_Pct")
  WHEN 'at the line' THEN printf('Extension %+.1f%% — price is sitting on the 30-week line. A crossing this narrow can reverse on a single session.', "Ext_Pct")
  ELSE '' END"""
WEINSTEIN = """concat_ws(' · ', CASE sk WHEN 'Stage 2' THEN 'Weinstein: price above a rising 30-week line is Stage 2'
  WHEN 'Stage 4' THEN 'Weinstein: never hold Stage 4' WHEN 'Stage 3' THEN 'Weinstein: Stage 3 is topping — reduce exposure'
  WHEN 'Stage 1' THEN 'Weinstein: Stage 1 is basing — wait for the breakout' END,
  CASE WHEN "Breakout_Confirmed" THEN 'Weinstein: breakout confirmed by volume' END)"""
ONEIL = """concat_ws(' · ', CASE WHEN "RS_Score" >= 80 THEN 'O''Neil: leadership requires RS ≥ 80'
  WHEN "RS_Score" IS NOT NULL THEN 'O''Neil: buy leaders, not laggards' END,
  CASE WHEN "RS_Line_NH_Before_Price" THEN 'O''Neil: the relative-strength line turning up before price is the leading tell' END)"""
MINERVINI = """concat_ws(' · ', CASE WHEN "VCP_Setup" THEN 'Minervini: a contracting range on drying volume is the base tightening before a move' END,
  CASE WHEN "Trend_Template_Pass" THEN 'Minervini: all eight trend-template criteria met (thresholds provisional)' END)"""


@register(
    "evidence_texts",
    """Symbol, RS_Text, Extension_Band, Volume_State, Wait_Note, Conflict_Note, Caution_Note,
    Weinstein_Line, Oneil_Line, Minervini_Line, Source_Line""", "supplier",
    f"""{o.snapshot('supplier')}, parts AS (
      SELECT "Symbol", {TOP} AS "RS_Text", {BAND} AS "Extension_Band", {VOLUME} AS "Volume_State",
        {WAIT} AS "Wait_Note", {CONFLICT} AS "Conflict_Note", {CAUTION} AS "Caution_Note",
        {WEINSTEIN} AS "Weinstein_Line", {ONEIL} AS "Oneil_Line", {MINERVINI} AS "Minervini_Line"
      FROM research),
    result AS (SELECT *, concat_ws(' · ', nullif("Weinstein_Line", ''), nullif("Oneil_Line", ''),
      nullif("Minervini_Line", '')) AS "Source_Line" FROM parts)""")
def _(i):
    return plans.texts(full(i))


@register(
    "signal_rows", "Symbol, signal, value, threshold, status, note", "supplier",
    f"""{o.snapshot('supplier')}, result AS (
      SELECT "Symbol", 'Stage' AS signal, coalesce(sk, '—') AS value, 'Stage 2 required to buy' AS threshold,
        CASE WHEN sk = 'Stage 2' THEN 'met' ELSE 'unmet' END AS status,
        CASE WHEN sk = 'Stage 2' THEN 'Price above a rising 30-week line' ELSE 'Not an entry condition' END AS note
      FROM research UNION ALL
      SELECT "Symbol", 'Relative strength', coalesce(printf('%.0f', "RS_Score"), '—'), '≥ 80 for leadership',
        CASE WHEN "RS_Score" >= 80 THEN 'met' ELSE 'unmet' END, {TOP} FROM research UNION ALL
      SELECT "Symbol", 'Volume ratio', CASE WHEN "Volume_Ratio" IS NULL THEN '—' WHEN isinf("Volume_Ratio") THEN '∞'
        ELSE format('{{:,.2f}}', "Volume_Ratio") || '×' END, '≥ 1.5× confirms a breakout',
        CASE WHEN "Volume_Ratio" > 1.5 THEN 'met' ELSE 'unmet' END, 'Latest session against the prior-50 baseline'
      FROM research UNION ALL
      SELECT "Symbol", 'U/D ratio', CASE WHEN "U_D" IS NULL THEN '—' WHEN isinf("U_D") THEN '∞'
        ELSE format('{{:,.2f}}', "U_D") END, '≥ 1.3 confirms accumulation',
        CASE WHEN "U_D" > 1.3 AND NOT isinf("U_D") THEN 'met' WHEN "U_D" < 0.7 THEN 'caution' ELSE 'unmet' END,
        upper(left({VOLUME}, 1)) || lower(substr({VOLUME}, 2)) FROM research UNION ALL
      SELECT "Symbol", 'Extension', CASE WHEN "Ext_Pct" IS NULL THEN '—' ELSE format('{{:,.1f}}%', "Ext_Pct") END,
        '< 20% is the comfort band', CASE WHEN abs("Ext_Pct") < 20 AND abs("Ext_Pct") >= 2 THEN 'met' ELSE 'caution' END,
        upper(left({BAND}, 1)) || substr({BAND}, 2) FROM research UNION ALL
      SELECT "Symbol", '30-week slope', CASE WHEN "MA_30W_Slope_10S_Pct" IS NULL THEN '—'
        ELSE format('{{:,.2f}}%', "MA_30W_Slope_10S_Pct") END, '> 0% means the line is rising',
        CASE WHEN "MA_30W_Slope_10S_Pct" > 0 THEN 'met' ELSE 'unmet' END, 'Change over 10 completed sessions'
      FROM research UNION ALL
      SELECT "Symbol", 'Near the 52-week high', CASE WHEN "Near_52W_High" THEN 'Yes' ELSE 'No' END,
        'within 3% for a breakout setup', CASE WHEN "Near_52W_High" THEN 'met' ELSE 'unmet' END,
        'Close against the 52-week adjusted high' FROM research)""")
def _(i):
    rows = full(i)
    return rows.select("Symbol", F.inline(text.signal_rows(rows.columns)))


@register(
    "oneil_checklist", "Symbol, label, met, met_count:i, items:i", "supplier",
    f"""{o.snapshot('supplier')}, r AS (
      SELECT *, coalesce("RS_Score" >= 80, false) AS m1, coalesce("Volume_Ratio" > 1.5 AND NOT isinf("Volume_Ratio"), false) AS m2,
        coalesce("U_D" > 1.3 AND NOT isinf("U_D"), false) AS m3, "RS_Line_At_High" AS m4,
        "RS_Line_NH_Before_Price" AS m5 FROM research),
    result AS (
      SELECT "Symbol", unnest(['Relative strength 80 or better (leadership)',
        'Volume 1.5× or more confirms the breakout', 'Up/down volume 1.3× or more confirms accumulation',
        'Relative-strength line at a 52-week high', 'Relative strength leading price out of the base']) AS label,
        unnest([m1, m2, m3, m4, m5]) AS met, m1::INT + m2::INT + m3::INT + m4::INT + m5::INT AS met_count,
        5 AS items FROM r)""")
def _(i):
    rows = full(i)
    items = text.oneil_checklist(rows.columns)
    rows = rows.withColumn("items_", items)
    return rows.select(
        "Symbol", text.checklist_met(F.col("items_")).alias("met_count"),
        F.size("items_").alias("items"), F.inline("items_"),
    )


@register(
    "formatted_values", "Symbol, close, value, r3m, ext, slope, volume, ud, rs, date", "supplier",
    f"""{o.snapshot('supplier')}, result AS (
      SELECT "Symbol", format('₹{{:,.2f}}', "Close") AS close,
        CASE WHEN "AvgValue20" IS NULL THEN '—' WHEN "AvgValue20" >= 1e7 THEN format('₹{{:,.2f}} Cr', "AvgValue20" / 1e7)
          WHEN "AvgValue20" >= 1e5 THEN format('₹{{:,.2f}} L', "AvgValue20" / 1e5)
          ELSE format('₹{{:,.0f}}', "AvgValue20") END AS value,
        coalesce(printf('%+.1f%%', "R3M" * 100), '—') AS r3m, coalesce(printf('%+.1f%%', "Ext_Pct"), '—') AS ext,
        coalesce(format('{{:,.2f}}', "MA_30W_Slope_10S_Pct"), '—') AS slope,
        CASE WHEN "Volume_Ratio" IS NULL THEN '—' WHEN isinf("Volume_Ratio") THEN '∞' ELSE printf('%.2f×', "Volume_Ratio") END AS volume,
        CASE WHEN "U_D" IS NULL THEN '—' WHEN isinf("U_D") THEN '∞' ELSE printf('%.2f×', "U_D") END AS ud,
        coalesce(printf('%.0f', "RS_Score"), '—') AS rs, strftime("Date", '%d %b %Y') AS date FROM research)""")
def _(i):
    return full(i).select(
        "Symbol", text.fmt_price("Close").alias("close"), text.fmt_inr("AvgValue20").alias("value"),
        text.fmt_return("R3M").alias("r3m"), text.fmt_pct("Ext_Pct").alias("ext"),
        text.fmt_number("MA_30W_Slope_10S_Pct").alias("slope"),
        text.fmt_ratio("Volume_Ratio").alias("volume"), text.fmt_ratio("U_D").alias("ud"),
        text.fmt_rs("RS_Score").alias("rs"), text.fmt_date("Date").alias("date"),
    )


@register(
    "range_and_bands", "Symbol, position:f, to_line:f, stage_shown, rs_band, tone", "supplier",
    f"""{o.snapshot('supplier')}, result AS (
      SELECT "Symbol", CASE WHEN "High_52W" > "Low_52W" THEN
          least(100, greatest(0, ("Close" - "Low_52W") / ("High_52W" - "Low_52W") * 100)) END AS position,
        ("MA_30W" / "Close" - 1) * 100 AS to_line,
        CASE sk WHEN 'Stage 1' THEN 'Stage 1 · Basing' WHEN 'Stage 2' THEN 'Stage 2 · Advancing'
          WHEN 'Stage 3' THEN 'Stage 3 · Topping' WHEN 'Stage 4' THEN 'Stage 4 · Declining'
          ELSE 'Unavailable' END AS stage_shown,
        CASE WHEN "RS_Score" >= 80 THEN 'Leadership' WHEN "RS_Score" >= 50 THEN 'Adequate'
          WHEN "RS_Score" >= 0 THEN 'Lagging' ELSE 'Unavailable' END AS rs_band,
        CASE WHEN "Ext_Pct" IS NULL THEN 'neutral' WHEN "Ext_Pct" >= 75 OR "Ext_Pct" < -2 THEN 'bad'
          WHEN "Ext_Pct" >= 20 OR "Ext_Pct" < 2 THEN 'warn' ELSE 'good' END AS tone FROM research)""")
def _(i):
    return full(i).select(
        "Symbol",
        rules.range_position(F.col("Low_52W"), F.col("Close"), F.col("High_52W")).alias("position"),
        rules.return_to_line().alias("to_line"),
        rules.stage_display("Stage").alias("stage_shown"),
        rules.rs_band().alias("rs_band"), rules.extension_tone().alias("tone"),
    )
