"""Screens, shelves, breadth, industries and distributions over the snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.operators import aggregates as agg
from breadthline.operators import indicators as ind
from breadthline.operators import screens
from breadthline.plans import research as plans
from breadthline.sources import panel, readers
from verification import oracle_base as o
from verification.inputs import DECISION
from verification.q_indicators import full, ma_sql, measured
from verification.registry import register

S = o.snapshot("supplier")
ALL = f"{S}, "
SHOWN = "Symbol, Industry, Stage, RS_Score:f, R3M:f, Ext_Pct:f, Action"


def _listed(name: str, columns: str, sql: str, variant: str = "supplier"):
    return register(name, columns, variant, f"{o.snapshot(variant)}, result AS ({sql})")


# --- screens -----------------------------------------------------------------------

PRESETS = """
  SELECT "Symbol", "RS_Score", 'Buy candidates' AS preset FROM research WHERE sk = 'Stage 2'
    AND "RS_Score" >= 80 AND NOT "Extended_20Pct" AND NOT "Below_50DMA" UNION ALL
  SELECT "Symbol", "RS_Score", 'Coiling' FROM research WHERE "VCP_Setup" UNION ALL
  SELECT "Symbol", "RS_Score", 'RS leading price' FROM research WHERE "RS_Line_NH_Before_Price" UNION ALL
  SELECT "Symbol", "RS_Score", 'Template pass' FROM research WHERE "Trend_Template_Pass" UNION ALL
  SELECT "Symbol", "RS_Score", 'Exit now' FROM research
  WHERE sk = 'Stage 4' OR (sk = 'Stage 3' AND "Distribution")"""


@_listed("screen_presets", "Symbol, RS_Score:f, preset", PRESETS)
def _(i):
    return screens.preset_members(full(i))


@_listed("screen_exit_now", SHOWN, """SELECT * FROM research
    WHERE sk = 'Stage 4' OR (sk = 'Stage 3' AND "Distribution")""")
def _(i):
    return screens.preset(full(i), "Exit now")


@_listed("screen_filters", SHOWN, """SELECT * FROM research WHERE sk = 'Stage 4'
    AND "Action" IN ('SELL', 'REDUCE', 'WATCH') AND "RS_Score" BETWEEN 5 AND 95""")
def _(i):
    return screens.screen(full(i), stage="Stage 4", actions=("SELL", "REDUCE", "WATCH"),
                          rs_low=5, rs_high=95)


@_listed("screen_search", SHOWN, """SELECT * FROM research
    WHERE contains(upper("Symbol" || ' ' || "Industry" || ' ' || "Company Name"), 'NATION_1')
    AND "RS_Score" BETWEEN 1 AND 99""")
def _(i):
    return screens.screen(full(i), search=" nation_1 ")


@_listed("screen_liquid", SHOWN, """SELECT * FROM research
    WHERE "Liquid_UI_Filter" AND "RS_Score" BETWEEN 1 AND 99""")
def _(i):
    return screens.screen(full(i), liquid_only=True)


@_listed("screen_sorted_page", SHOWN, """SELECT * FROM research
    ORDER BY "MaxDD_12M" DESC NULLS LAST, "Symbol" LIMIT 5 OFFSET 5""")
def _(i):
    return screens.page(full(i), "Shallowest 12-month fall", 2, 5)


@_listed("screen_page_count", "total:i, pages:i", """SELECT count(*) AS total,
    greatest(1, ceil(count(*) / 50.0)) AS pages FROM research""")
def _(i):
    return screens.page_count(full(i))


EVIDENCE = """("Trend_Template_Pass"::INT + "RS_Line_NH_Before_Price"::INT + "VCP_Setup"::INT
  + coalesce("Stage1_Readiness" >= 4, false)::INT)"""


@_listed("setup_groups", "Symbol, Setup_Evidence:i, group", f"""
  SELECT "Symbol", {EVIDENCE} AS "Setup_Evidence", 'Trend template' AS "group" FROM research
    WHERE "Trend_Template_Pass" UNION ALL
  SELECT "Symbol", {EVIDENCE}, 'RS leading price' FROM research WHERE "RS_Line_NH_Before_Price" UNION ALL
  SELECT "Symbol", {EVIDENCE}, 'Contracting base' FROM research WHERE "VCP_Setup" UNION ALL
  SELECT "Symbol", {EVIDENCE}, 'Stage 1 ready' FROM research WHERE "Stage1_Readiness" >= 4 UNION ALL
  SELECT "Symbol", {EVIDENCE}, 'Stacked (2+)' FROM research WHERE {EVIDENCE} >= 2 UNION ALL
  SELECT "Symbol", {EVIDENCE}, 'All' FROM research""")
def _(i):
    return screens.setup_members(full(i))


@_listed("setups_closest_to_pivot", "Symbol, Pct_To_Pivot:f, Setup_Evidence:i", f"""
  SELECT *, {EVIDENCE} AS "Setup_Evidence" FROM research
  ORDER BY "Pct_To_Pivot" ASC NULLS LAST, "Symbol" LIMIT 10""")
def _(i):
    return screens.setups(full(i), "All", liquid_only=False, sort="Closest to pivot").limit(10)


@_listed("shelf_rs_leadership", "Symbol, RS_Score:f", """SELECT * FROM research
    WHERE "RS_Score" >= 80 ORDER BY "RS_Score" DESC, "Symbol" LIMIT 14""")
def _(i):
    return screens.shelf(full(i), "RS leadership")


@_listed("shelf_timing_warnings", "Symbol, RS_Score:f", """SELECT * FROM research
    WHERE sk = 'Stage 2' AND "RS_Score" >= 80 AND ("Extended_20Pct" OR "Below_50DMA")
    ORDER BY "RS_Score" DESC, "Symbol" LIMIT 14""")
def _(i):
    return screens.shelf(full(i), "Timing warnings in leadership")


@_listed("briefing_weak_structure", "Symbol, RS_Score:f, Stage", """SELECT * FROM research
    WHERE sk IN ('Stage 3', 'Stage 4') ORDER BY "RS_Score" ASC NULLS LAST, "Symbol" LIMIT 6""")
def _(i):
    return screens.briefing(full(i))["weak"]


@_listed("strongest_3m", "Symbol, R3M:f, Stage, Action",
         'SELECT * FROM research ORDER BY "R3M" DESC NULLS LAST, "Symbol" LIMIT 15')
def _(i):
    return screens.strongest(full(i), 15)


@_listed("weakest_3m", "Symbol, R3M:f, Stage, Action",
         'SELECT * FROM research ORDER BY "R3M" ASC NULLS LAST, "Symbol" LIMIT 15')
def _(i):
    return screens.weakest(full(i), 15)


@_listed("leader_board", "Symbol, RS_Score:f, Breakout_Confirmed, Action", """
    SELECT * FROM research WHERE "Action" IN ('BUY★', 'BUY', 'HOLD')
    ORDER BY "RS_Score" DESC NULLS LAST, "Breakout_Confirmed" DESC, "Symbol" LIMIT 15""")
def _(i):
    return screens.leader_board(full(i))


@_listed("setup_board", "Symbol, RS_Score:f, Breakout_Confirmed, R3M:f", """
    SELECT * FROM research ORDER BY "Breakout_Confirmed" DESC, "RS_Score" DESC NULLS LAST,
    "R3M" DESC NULLS LAST, "Symbol" LIMIT 50""")
def _(i):
    return screens.setup_board(full(i))


@_listed("top_symbol", "Symbol, RS_Score:f",
         'SELECT * FROM research ORDER BY "RS_Score" DESC NULLS LAST, "Symbol" LIMIT 1')
def _(i):
    return screens.top_symbol(full(i))


@_listed("industry_members", SHOWN, """SELECT * FROM research WHERE "Industry" = 'ASIA'""", "nation")
def _(i):
    return screens.industry_members(full(i), "ASIA")


@_listed("industry_stage_counts", "Industry, Stocks:i, Stage_1:i, Stage_2:i, Stage_3:i, Stage_4:i", """
  SELECT "Industry", count(*) AS "Stocks", count(*) FILTER (WHERE sk = 'Stage 1') AS "Stage_1",
    count(*) FILTER (WHERE sk = 'Stage 2') AS "Stage_2", count(*) FILTER (WHERE sk = 'Stage 3') AS "Stage_3",
    count(*) FILTER (WHERE sk = 'Stage 4') AS "Stage_4" FROM research GROUP BY "Industry" """)
def _(i):
    return screens.industry_stage_counts(full(i))


@_listed("returns_with_cost", "Symbol, window, return:f, drawdown:f", """
  SELECT "Symbol", unnest(['3M', '6M', '9M', '12M']) AS "window",
    unnest(["R3M", "R6M", "R9M", "R12M"]) AS "return",
    unnest(["MaxDD_3M", "MaxDD_6M", "MaxDD_9M", "MaxDD_12M"]) AS drawdown FROM research""")
def _(i):
    return screens.returns_with_cost(measured(i))


# --- breadth -----------------------------------------------------------------------

BREADTH = """SELECT count(*) AS symbols, count(sk) AS classified,
    count(*) FILTER (WHERE "Above_MA_30W") AS above_ma_30w,
    count(*) FILTER (WHERE "Above_MA_10W") AS above_ma_10w,
    count(*) FILTER (WHERE "Near_52W_High") AS near_52w_high,
    count(*) FILTER (WHERE "Breakout") AS breakout,
    count(*) FILTER (WHERE "Breakout_Confirmed") AS breakout_confirmed,
    count(*) FILTER (WHERE "Distribution") AS distribution,
    count(*) FILTER (WHERE sk = 'Stage 1') AS stage_1, count(*) FILTER (WHERE sk = 'Stage 2') AS stage_2,
    count(*) FILTER (WHERE sk = 'Stage 3') AS stage_3, count(*) FILTER (WHERE sk = 'Stage 4') AS stage_4,
    count("RS_Score") AS valid_rs, count(*) FILTER (WHERE "RS_Score" >= 80) AS rs_leaders,
    count(*) FILTER (WHERE "RS_Score" < 50) AS rs_lagging,
    100.0 * count(*) FILTER (WHERE "Above_MA_30W") / nullif(count(sk), 0) AS pct_above_ma_30w,
    100.0 * count(*) FILTER (WHERE "Above_MA_10W") / nullif(count(sk), 0) AS pct_above_ma_10w
  FROM research"""
REGIME = """CASE WHEN pct_above_ma_30w >= 60 THEN 'Broad' WHEN pct_above_ma_30w >= 40 THEN 'Mixed'
  WHEN pct_above_ma_30w >= 0 THEN 'Narrow' ELSE 'Unavailable' END"""


@register(
    "breadth_snapshot",
    """symbols:i, classified:i, above_ma_30w:i, above_ma_10w:i, near_52w_high:i, breakout:i,
    breakout_confirmed:i, distribution:i, stage_1:i, stage_2:i, stage_3:i, stage_4:i, valid_rs:i,
    rs_leaders:i, rs_lagging:i, pct_above_ma_30w:f, pct_above_ma_10w:f, regime,
    regime_description""", "nation",
    f"""{o.snapshot('nation')}, b AS ({BREADTH}), result AS (
      SELECT *, {REGIME} AS regime, CASE {REGIME}
        WHEN 'Broad' THEN 'Most of the universe is above its 30-week line.'
        WHEN 'Mixed' THEN 'Participation is split around the 30-week line.'
        WHEN 'Narrow' THEN 'Most of the universe is below its 30-week line.'
        ELSE 'Breadth cannot be measured from this snapshot.' END AS regime_description FROM b)""")
def _(i):
    return agg.breadth_snapshot(full(i))


@register(
    "breadth_history",
    """date:d, symbols:i, above_ma_30w:i, symbols_ma_10w:i, above_ma_10w:i, pct_above_ma_30w:f,
    pct_above_ma_10w:f, benchmark_close:f, benchmark_ticker""", "settled",
    f"""{ma_sql('settled')}, {o.BENCH}, d AS (
      SELECT date, count(*) FILTER (WHERE ma_30w IS NOT NULL) AS symbols,
        count(*) FILTER (WHERE close > ma_30w) AS above_ma_30w,
        count(*) FILTER (WHERE ma_10w IS NOT NULL) AS symbols_ma_10w,
        count(*) FILTER (WHERE close > ma_10w) AS above_ma_10w
      FROM ma WHERE recency <= 250 GROUP BY date),
    result AS (
      SELECT d.*, 100.0 * above_ma_30w / symbols AS pct_above_ma_30w,
        100.0 * above_ma_10w / nullif(symbols_ma_10w, 0) AS pct_above_ma_10w,
        bench.close AS benchmark_close, 'VWAP' AS benchmark_ticker
      FROM d LEFT JOIN bench USING (date)
      WHERE symbols >= greatest(1, floor((SELECT count(DISTINCT symbol) FROM bars) * 0.25)))""")
def _(i):
    # Both reads of the trend rows (universe size, daily counts) come from one table.
    trends = plans.land(ind.trend_frame(i.bars(), c.PANEL_SESSIONS), "trends")
    history = agg.breadth_history(trends, c.BREADTH_SESSIONS, 0.25)
    return agg.with_benchmark_column(history, i.benchmark(), "VWAP")


@register(
    "industry_leadership",
    """Industry, Stocks:i, Median_RS:f, Median_R3M:f, Stage2:i, Participation:i, Confirmed:i,
    Near_High:i, Participation_Pct:f""", "supplier",
    f"""{S}, result AS (
      SELECT coalesce("Industry", 'Unclassified') AS "Industry", count(*) AS "Stocks",
        median("RS_Score") AS "Median_RS", median("R3M") AS "Median_R3M",
        count(*) FILTER (WHERE sk = 'Stage 2') AS "Stage2",
        count(*) FILTER (WHERE "Above_MA_30W") AS "Participation",
        count(*) FILTER (WHERE "Breakout_Confirmed") AS "Confirmed",
        count(*) FILTER (WHERE "Near_52W_High") AS "Near_High",
        100.0 * count(*) FILTER (WHERE "Above_MA_30W") / nullif(count(sk), 0) AS "Participation_Pct"
      FROM research GROUP BY 1)""")
def _(i):
    return agg.industry_leadership(plans.land(full(i), "snapshot"))


BOARD = """board AS (
      SELECT coalesce("Industry", 'Unclassified') AS "Industry", count(*) AS "Stocks",
        median("RS_Score") AS "Median_RS", median("R3M") AS "Median_R3M",
        100.0 * count(*) FILTER (WHERE "Above_MA_30W") / nullif(count(sk), 0) AS "Participation_Pct"
      FROM research GROUP BY 1)"""
ORDERS = " UNION ALL ".join(
    f"""SELECT '{sort}' AS sort, row_number() OVER (ORDER BY "{column}"
      {'ASC' if up else 'DESC'} NULLS LAST, "Industry") AS place, "Industry" FROM board"""
    for sort, (column, up) in c.INDUSTRY_SORTS.items())


@register("industry_sorts", "sort, place:i, Industry", "supplier", f"{S}, {BOARD}, result AS ({ORDERS})")
def _(i):
    board = plans.land(agg.industry_leadership(plans.land(full(i), "snapshot")), "board")
    # Ids grow in the order of the sorted rows; the board has a row for each industry.
    in_order = Window.partitionBy("sort").orderBy("at")
    placed = [
        screens.industries(board, sort).select(
            F.lit(sort).alias("sort"), "Industry", F.monotonically_increasing_id().alias("at"))
        for sort in c.INDUSTRY_SORTS
    ]
    return reduce(DataFrame.unionByName, [plans.land(p, "sorted") for p in placed]).withColumn(
        "place", F.row_number().over(in_order))


@register(
    "exact_median_price", "day:d, median_price:f", "nation",
    """WITH result AS (SELECT CAST(l_shipdate AS DATE) AS day,
      median(l_extendedprice / l_quantity) AS median_price FROM lineitem GROUP BY 1)""")
def _(i):
    from breadthline.operators.ranking import exact_medians

    prices = i.table("lineitem").select(
        F.col("l_shipdate").cast("date").alias("day"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
    )
    return exact_medians(prices, ["day"], "price", "median_price")


@register(
    "industry_actions",
    """Industry, Stocks:i, Avg_RS:f, Median_RS:f, Leadership:i, Stage2:i, Confirmed:i, Buy:i,
    Reduce:i, Sell:i""", "supplier",
    f"""{S}, result AS (
      SELECT "Industry", count(*) AS "Stocks", avg("RS_Score") AS "Avg_RS", median("RS_Score") AS "Median_RS",
        count(*) FILTER (WHERE "RS_Score" >= 80) AS "Leadership",
        count(*) FILTER (WHERE sk = 'Stage 2') AS "Stage2",
        count(*) FILTER (WHERE "Breakout_Confirmed") AS "Confirmed",
        count(*) FILTER (WHERE "Action" IN ('BUY★', 'BUY')) AS "Buy",
        count(*) FILTER (WHERE "Action" = 'REDUCE') AS "Reduce",
        count(*) FILTER (WHERE "Action" = 'SELL') AS "Sell" FROM research GROUP BY 1)""")
def _(i):
    return agg.industry_actions(full(i))


@register(
    "action_distribution", "position:i, Action, Stocks:i, Share_Pct:f", "supplier",
    f"""{S}, dom AS (
      SELECT unnest(range(9)) AS position,
        unnest(['BUY★', 'BUY', 'HOLD', 'WAIT', 'WATCH★', 'WATCH', 'REDUCE', 'SELL', 'AVOID']) AS a),
    result AS (
      SELECT position, a AS "Action", count(r."Symbol") AS "Stocks",
        100.0 * count(r."Symbol") / (SELECT count(*) FROM research) AS "Share_Pct"
      FROM dom LEFT JOIN research r ON r."Action" = a GROUP BY 1, 2)""")
def _(i):
    return agg.action_distribution(full(i))


@register(
    "stage_distribution", "position:i, Stage, Stocks:i", "supplier",
    f"""{S}, dom AS (SELECT unnest(range(4)) AS position,
      unnest(['Stage 1', 'Stage 2', 'Stage 3', 'Stage 4']) AS s),
    result AS (SELECT position, s AS "Stage", count(r."Symbol") AS "Stocks"
      FROM dom LEFT JOIN research r ON r.sk = s GROUP BY 1, 2)""")
def _(i):
    return agg.stage_distribution(measured(i))


@_listed("stage2_regime", "stage2_pct:f, regime", """
  SELECT 100.0 * count(*) FILTER (WHERE sk = 'Stage 2') / count(*) AS stage2_pct,
    CASE WHEN count(*) FILTER (WHERE sk = 'Stage 2') / count(*) > 0.45 THEN 'Broad participation'
      ELSE 'Selective participation' END AS regime FROM research""")
def _(i):
    return agg.stage2_regime(measured(i))


@register(
    "snapshot_summary", "decision_date, universe_rows:i, research_rows:i, valid_rs:i, stage_4:i, pct:f",
    "supplier",
    f"""{S}, b AS ({BREADTH}), result AS (
      SELECT (SELECT b FROM bnd)::VARCHAR AS decision_date, (SELECT count(*) FROM universe) AS universe_rows,
        symbols AS research_rows, valid_rs, stage_4, round(pct_above_ma_30w, 2) AS pct FROM b)""")
def _(i):
    parsed = F.from_json(
        "summary",
        "decision_date string, universe_rows bigint, research_rows bigint, valid_rs bigint, "
        "stages struct<`Stage 4`: bigint>, above_30_week_pct double",
    )
    summary = agg.snapshot_summary(full(i), i.universe())
    return summary.select(parsed.alias("s")).select(
        "s.decision_date", "s.universe_rows", "s.research_rows", "s.valid_rs",
        F.col("s.stages.`Stage 4`").alias("stage_4"), F.col("s.above_30_week_pct").alias("pct"),
    )


# --- price panel -----------------------------------------------------------------------

PANEL = f"""{ma_sql('settled')}, panel AS (
  SELECT symbol, date, close::FLOAT AS close FROM ma WHERE recency <= 420)"""


def _panel(i):
    return plans.land(panel.panel_of(ind.trend_frame(i.bars())), "panel")


@register("panel_series", "date:d, close:f", "settled",
          f"{PANEL}, result AS (SELECT * FROM panel WHERE symbol = 'NATION_1' AND close IS NOT NULL)")
def _(i):
    return panel.series(_panel(i), "NATION_1")


@register(
    "panel_tails", "symbol, k:i, close:f", "settled",
    f"""{PANEL}, cut AS (SELECT min(date) AS d FROM (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 30)),
    result AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k, close FROM panel
      WHERE close IS NOT NULL AND date >= (SELECT d FROM cut)
      QUALIFY count(*) OVER (PARTITION BY symbol) >= 2)""")
def _(i):
    return panel.tails(_panel(i), 30).select("symbol", F.posexplode("closes").alias("k", "close"))


@register("panel_terminal_session", "terminal_session:d", "settled",
          f"{PANEL}, result AS (SELECT max(date) AS terminal_session FROM panel)")
def _(i):
    return panel.terminal_session(_panel(i))


@register(
    "research_reread", "Symbol, Industry, Company Name, Stage_Label, Action", "supplier",
    f"""{S}, result AS (SELECT *, sk AS "Stage_Label" FROM research)""")
def _(i):
    published = full(i).drop("Industry", "Action", "Action_Reason")
    return readers.enriched_research(published, i.universe())


@register(
    "breadth_reread", "Date:d, symbols:i", "settled",
    f"""WITH {o.bars('settled')}, result AS (
      SELECT date AS "Date", count(*) AS symbols FROM bars
      WHERE close IS NOT NULL AND date < DATE '{DECISION}' GROUP BY 1)""")
def _(i):
    from breadthline.operators.boundary import session_coverage

    text = session_coverage(i.bars(), DECISION).select(
        F.col("date").cast("string").alias("Date"), "symbols"
    )
    bad = text.withColumn("Date", F.concat(F.lit("not a date "), F.col("Date")))
    return readers.clean_breadth(text.unionByName(bad))
