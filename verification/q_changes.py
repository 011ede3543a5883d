"""Changes between snapshots, corporate actions, the forward record, reconciliation, swings."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.operators import corporate, indicators, movers, reconcile, record, swings
from breadthline.operators import boundary as b
from breadthline.plans import audit
from breadthline.plans import research as plans
from breadthline.session import land
from verification import oracle_base as o
from verification import oracle_swings as sw
from verification.inputs import DECISION
from verification.q_indicators import full, measured
from verification.registry import register

TWO = o.two_snapshots("supplier")
NATION_TWO = o.two_snapshots("nation")


def _pair(i):
    bars, bench, names = i.landed_bars(by_symbol=True), i.landed_benchmark(), i.universe()
    day = i.boundary()
    current = land(plans.research(bars, names, day, bench, i.variant.min_sessions), "current")
    _, previous = audit.previous_snapshot(
        bars, names, current, day, i.variant.min_pct, bench, i.variant.min_sessions)
    return current, previous


@register("previous_snapshot", "Symbol, Date:d, RS_Score:f, Stage, Action, TT8_RS", "settled",
          o.two_snapshots("settled"), "p_research")
def _(i):
    return _pair(i)[1]


@register(
    "audit_excluded", "symbol, reason", "settled",
    f"""WITH {o.bars('settled')}, doubled AS (
      SELECT symbol, date FROM bars UNION ALL
      SELECT symbol, date FROM bars WHERE symbol LIKE 'NATION_1%' AND day(date) = 1),
    bad AS (SELECT DISTINCT symbol FROM (
      SELECT symbol FROM doubled GROUP BY symbol, date HAVING count(*) > 1)),
    clean AS (SELECT * FROM bars WHERE symbol NOT IN (SELECT symbol FROM bad)),
    {re.sub(r"FROM bars", "FROM clean", o.boundary('settled'))}, result AS (
      SELECT u."Symbol" AS symbol, CASE
        WHEN u."Symbol" IN (SELECT symbol FROM bad) THEN 'Duplicate market-data sessions detected'
        WHEN k.symbol IS NULL THEN 'the provider returned no history'
        WHEN k.d IS NULL THEN 'No completed market session exists before decision date'
        ELSE 'no completed session at the global boundary ' || (SELECT b FROM bnd)::VARCHAR
          || '; its latest is ' || k.d::VARCHAR END AS reason
      FROM universe u LEFT JOIN (
        SELECT symbol, max(date) FILTER (WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)) AS d
        FROM clean GROUP BY symbol) k ON k.symbol = u."Symbol"
      WHERE k.d IS NULL OR k.d <> (SELECT b FROM bnd))""")
def _(i):
    bars, names = i.landed_bars(), i.universe()
    doubled = bars.unionByName(bars.where("symbol LIKE 'NATION_1%' AND day(date) = 1"))
    clean, rejected = audit.admitted(doubled, names)
    day = b.information_boundary(clean, names.count(), DECISION, i.variant.min_pct)
    return b.unavailable(names.withColumnRenamed("Symbol", "symbol"), clean, day, rejected)


JOINED = """j AS (SELECT r.*, p."Stage" AS p_stage, p.sk AS p_sk, p."Action" AS p_action,
  p."RS_Score" AS p_rs, p."Breakout" AS p_bo, p."Breakout_Confirmed" AS p_bc,
  p."Above_MA_10W" AS p_10, p."Near_52W_High" AS p_near, p."Extended_20Pct" AS p_ext,
  p."Distribution" AS p_dist FROM research r JOIN p_research p ON p."Symbol" = r."Symbol")"""

MOVES = """moves AS (
  SELECT "Symbol", 'Entered Stage 2 — Advancing' AS "group", p_sk AS value_from, sk AS value_to FROM j WHERE sk <> p_sk AND sk = 'Stage 2' UNION ALL
  SELECT "Symbol", 'Left Stage 2 — Advancing', p_sk, sk FROM j WHERE sk <> p_sk AND p_sk = 'Stage 2' UNION ALL
  SELECT "Symbol", 'Entered Stage 4 — Declining', p_sk, sk FROM j WHERE sk <> p_sk AND sk = 'Stage 4' UNION ALL
  SELECT "Symbol", 'New breakout setup', p_bo::VARCHAR, "Breakout"::VARCHAR FROM j WHERE "Breakout" AND NOT p_bo UNION ALL
  SELECT "Symbol", 'Newly confirmed breakout', p_bc::VARCHAR, "Breakout_Confirmed"::VARCHAR FROM j WHERE "Breakout_Confirmed" AND NOT p_bc UNION ALL
  SELECT "Symbol", 'Lost breakout confirmation', p_bc::VARCHAR, "Breakout_Confirmed"::VARCHAR FROM j WHERE NOT "Breakout_Confirmed" AND p_bc UNION ALL
  SELECT "Symbol", 'Reclaimed the 10-week line', p_10::VARCHAR, "Above_MA_10W"::VARCHAR FROM j WHERE "Above_MA_10W" AND NOT p_10 UNION ALL
  SELECT "Symbol", 'Lost the 10-week line', p_10::VARCHAR, "Above_MA_10W"::VARCHAR FROM j WHERE NOT "Above_MA_10W" AND p_10 UNION ALL
  SELECT "Symbol", 'Moved within 3% of the 52-week high', p_near::VARCHAR, "Near_52W_High"::VARCHAR FROM j WHERE "Near_52W_High" AND NOT p_near UNION ALL
  SELECT "Symbol", 'Newly extended beyond 20%', p_ext::VARCHAR, "Extended_20Pct"::VARCHAR FROM j WHERE "Extended_20Pct" AND NOT p_ext UNION ALL
  SELECT "Symbol", 'New distribution warning', p_dist::VARCHAR, "Distribution"::VARCHAR FROM j WHERE "Distribution" AND NOT p_dist UNION ALL
  SELECT "Symbol", 'Distribution warning cleared', p_dist::VARCHAR, "Distribution"::VARCHAR FROM j WHERE NOT "Distribution" AND p_dist UNION ALL
  SELECT "Symbol", 'Action changed', p_action, "Action" FROM j WHERE "Action" <> p_action)"""


@register("stage_changes", "Symbol, RS_Score:f, Stage_From, Stage_To", "nation",
          f"""{NATION_TWO}, {JOINED}, result AS (
            SELECT "Symbol", "RS_Score", p_sk AS "Stage_From", sk AS "Stage_To" FROM j WHERE sk <> p_sk)""")
def _(i):
    return movers.stage_changes(*_pair(i))


@register("transitions", "Symbol, group, value_from, value_to", "nation",
          f"{NATION_TWO}, {JOINED}, {MOVES}", "moves")
def _(i):
    return movers.transitions(*_pair(i))


@register("transition_counts", "group, symbols:i", "supplier",
          f"""{TWO}, {JOINED}, {MOVES}, result AS (
            SELECT "group", count(*) AS symbols FROM moves GROUP BY 1)""")
def _(i):
    return movers.transition_counts(*_pair(i))


@register("rs_movers", "Symbol, RS_Score:f, RS_Previous:f, RS_Change:f", "nation",
          f"""{NATION_TWO}, {JOINED}, result AS (
            SELECT "Symbol", "RS_Score", p_rs AS "RS_Previous", "RS_Score" - p_rs AS "RS_Change" FROM j
            WHERE "RS_Score" IS NOT NULL AND p_rs IS NOT NULL
            ORDER BY abs("RS_Score" - p_rs) DESC, "Symbol" LIMIT 15)""")
def _(i):
    return movers.rs_movers(*_pair(i))


@register("transition_pages", "group, inline, symbols:i, first_symbol, last_symbol", "supplier",
          f"""{TWO}, {JOINED}, {MOVES}, placed AS (
            SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY "Symbol") <= 25 AS inline
            FROM moves),
          result AS (
            SELECT "group", inline, count(*) AS symbols, min("Symbol") AS first_symbol,
              max("Symbol") AS last_symbol FROM placed GROUP BY 1, 2)""")
def _(i):
    paged = movers.shown_first(land(movers.transitions(*_pair(i)), "moves"))
    return paged.groupBy("group", F.col("Inline").alias("inline")).agg(
        F.count(F.lit(1)).alias("symbols"), F.min("Symbol").alias("first_symbol"),
        F.max("Symbol").alias("last_symbol"))


# --- corporate actions -----------------------------------------------------------------

EVENTS = "Symbol, Date:d, Move_Pct:f, Ratio:f, Prev_Close:f, Close:f, Looks_Like, Match_Gap:f, Kind"


def ratios(variant: str) -> str:
    return f"""WITH {o.bars(variant)}, ratios AS (
      SELECT symbol, date, close, lag(close) OVER w AS prev, close / lag(close) OVER w AS ratio
      FROM bars WHERE close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


KNOWN = ", ".join(f"({i}, {t}::DOUBLE, '{label}')" for i, (t, label) in enumerate(c.KNOWN_ACTIONS))


def events(threshold: float, since: str | None = None) -> str:
    window = f"AND r.date >= {since}" if since else ""
    return f"""known(k, target, label) AS (VALUES {KNOWN}),
    best AS (
      SELECT r.*, abs(r.ratio - target) / target AS gap, label FROM ratios r, known
      WHERE abs(r.ratio - 1) > {threshold} AND r.ratio > 0 {window}
      QUALIFY row_number() OVER (PARTITION BY r.symbol, r.date ORDER BY gap, k) = 1),
    events AS (
      SELECT symbol AS "Symbol", date AS "Date", round((ratio - 1) * 100, 2) AS "Move_Pct",
        round(ratio, 6) AS "Ratio", round(prev, 4) AS "Prev_Close", round(close, 4) AS "Close",
        CASE WHEN gap <= 0.04 THEN label ELSE 'demerger or spin-off (no clean split ratio)' END AS "Looks_Like",
        round(gap, 4) AS "Match_Gap",
        CASE WHEN gap <= 0.04 THEN 'split/bonus' ELSE 'unclassified' END AS "Kind" FROM best)"""


@register("corporate_actions", "Symbol, Date:d, Looks_Like, Kind", "settled",
          f"{ratios('settled')}, {events(0.35)}", "events")
def _(i):
    return corporate.scan(i.bars())


@register(
    "corporate_action_moves", "Symbol, Date:d, move:f, match_gap:f", "settled",
    f"""{ratios('settled')}, {events(0.35)}, result AS (
      SELECT symbol AS "Symbol", date AS "Date", (ratio - 1) * 100 AS move, gap AS match_gap FROM best)""")
def _(i):
    rows = corporate.close_ratios(i.bars()).filter(
        corporate.is_jump(F.col("ratio"), c.IMPLAUSIBLE_MOVE)
    )
    return rows.select(
        F.col("symbol").alias("Symbol"), F.col("date").alias("Date"),
        ((F.col("ratio") - 1.0) * 100.0).alias("move"),
        corporate.classify_ratio(F.col("ratio"))["gap"].alias("match_gap"),
    )


@register(
    "corporate_action_flags", "Symbol, Corporate_Action, Corporate_Action_Date, Corporate_Action_Kind",
    "supplier",
    f"""{o.snapshot('supplier')}, ratios AS (
      SELECT symbol, date, close, lag(close) OVER w AS prev, close / lag(close) OVER w AS ratio
      FROM bars WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)
      WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    {events(25.0, "(SELECT b FROM bnd) - 364")}, newest AS (
      SELECT "Symbol", max("Date") AS d, arg_max("Looks_Like", "Date") AS k FROM events GROUP BY 1),
    result AS (
      SELECT r."Symbol", n.d IS NOT NULL AS "Corporate_Action",
        coalesce(strftime(n.d, '%Y-%m-%d'), '') AS "Corporate_Action_Date",
        coalesce(n.k, '') AS "Corporate_Action_Kind"
      FROM research r LEFT JOIN newest n ON n."Symbol" = r."Symbol")""")
def _(i):
    day, bars = i.boundary(), i.landed_bars()
    found = corporate.report(bars, day, i.universe().count(), threshold=25.0, guard=False)
    return corporate.flag_rows(measured(i), found)


@register(
    "corporate_action_notices", "Symbol, notice", "supplier",
    f"""{o.snapshot('supplier')}, ratios AS (
      SELECT symbol, date, close, lag(close) OVER w AS prev, close / lag(close) OVER w AS ratio
      FROM bars WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)
      WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    {events(25.0, "(SELECT b FROM bnd) - 364")}, newest AS (
      SELECT "Symbol", max("Date") AS d, arg_max("Looks_Like", "Date") AS k FROM events GROUP BY 1),
    result AS (
      SELECT r."Symbol", CASE WHEN n.d IS NULL THEN '' ELSE 'Corporate action in this history on '
        || strftime(n.d, '%Y-%m-%d') || '. A single session moved more than a circuit limit allows, so it is not a price move. The stage, the relative strength and the 52-week figures are all measured across it, so they describe this price series rather than the business. Nothing has been corrected. Closest match: '
        || n.k END AS notice
      FROM research r LEFT JOIN newest n ON n."Symbol" = r."Symbol")""")
def _(i):
    from breadthline.functions.text import corporate_action_notice

    day, bars = i.boundary(), i.landed_bars()
    found = corporate.report(bars, day, i.universe().count(), threshold=25.0, guard=False)
    flagged = corporate.flag_rows(measured(i), found)
    return flagged.select("Symbol", corporate_action_notice(
        "Corporate_Action", "Corporate_Action_Date", "Corporate_Action_Kind").alias("notice"))


@register(
    "spans_discontinuity", "symbol, start:d, end:d, spans_jump", "supplier",
    f"""{ratios('supplier')}, spans AS (
      SELECT symbol, date AS s, date + 28 AS e FROM bars WHERE close IS NOT NULL),
    jumps AS (SELECT symbol, date FROM ratios WHERE abs(ratio - 1) > 5.0),
    result AS (SELECT s.symbol, s.s AS start, s.e AS "end", EXISTS (
        SELECT 1 FROM jumps j WHERE j.symbol = s.symbol AND j.date > s.s AND j.date <= s.e) AS spans_jump
      FROM spans s)""")
def _(i):
    bars = i.landed_bars()
    spans = bars.filter(F.col("close").isNotNull()).select(
        "symbol", F.col("date").alias("start"), F.date_add("date", 28).alias("end")
    )
    return corporate.discontinuities(bars, spans, threshold=5.0)


# --- forward record --------------------------------------------------------------------

MEMBERS = """members AS (
  SELECT "Symbol", 'universe' AS cohort FROM research UNION ALL
  SELECT "Symbol", 'buy_star' FROM research WHERE "Action" = 'BUY★' UNION ALL
  SELECT "Symbol", 'stage2_rs80' FROM research WHERE sk = 'Stage 2' AND "RS_Score" >= 80 UNION ALL
  SELECT "Symbol", 'trend_template' FROM research WHERE "Trend_Template_Pass" UNION ALL
  SELECT "Symbol", 'breakout_confirmed' FROM research WHERE "Breakout_Confirmed")"""


@register("cohort_members", "Symbol, cohort", "supplier",
          f"{o.snapshot('supplier')}, {MEMBERS}", "members")
def _(i):
    return record.cohort_members(full(i))


def forward(source: str, name: str, threshold: float = 5.0) -> str:
    """Forward returns of a (symbol, date, close) relation, by correlated lookups."""
    return f"""{name}_c AS (SELECT symbol, date, close, close / lag(close) OVER (
        PARTITION BY symbol ORDER BY date) AS ratio FROM {source} WHERE close IS NOT NULL),
    {name}_e AS (
      SELECT a.symbol, a.date, a.close, h.w, b.date AS e, b.close AS ec
      FROM (SELECT *, w FROM {name}_c, (VALUES (4), (8), (13)) h(w)) a
      JOIN (VALUES (4), (8), (13)) h(w) ON h.w = a.w
      ASOF LEFT JOIN {name}_c b ON a.symbol = b.symbol AND a.date + 7 * a.w <= b.date),
    {name} AS (
      SELECT symbol, date AS snapshot_date, w AS horizon_weeks, e AS end_date,
        CASE WHEN e IS NOT NULL AND close > 0 AND NOT EXISTS (
          SELECT 1 FROM {name}_c j WHERE j.symbol = x.symbol AND j.date > x.date AND j.date <= x.e
          AND abs(j.ratio - 1) > {threshold}) THEN (ec / close - 1) * 100 END AS return_pct
      FROM {name}_e x)"""


@register("forward_returns", "symbol, snapshot_date:d, horizon_weeks:i, end_date:d, return_pct:f",
          "settled", f"WITH {o.bars('settled')}, {forward('bars', 'fwd')}", "fwd")
def _(i):
    return record.forward_returns(i.bars(), threshold=5.0)


DAYS = """days AS (SELECT DISTINCT date_trunc('month', date)::DATE AS snapshot_date FROM bench)"""
DUE = """lim AS (SELECT min(date) AS d FROM (SELECT date FROM bench ORDER BY date DESC LIMIT 4)),
  done AS (SELECT snapshot_date, 4 AS horizon_weeks FROM days WHERE snapshot_date < DATE '1998-01-01'),
  due AS (SELECT snapshot_date, w AS horizon_weeks FROM days, (VALUES (4), (8), (13)) h(w)
    WHERE snapshot_date + 7 * w <= (SELECT d FROM lim) AND NOT EXISTS (
      SELECT 1 FROM done WHERE done.snapshot_date = days.snapshot_date AND done.horizon_weeks = w))"""


@register("pending_grades", "snapshot_date:d, horizon_weeks:i", "nation",
          f"WITH {o.BENCH}, {DAYS}, {DUE}", "due")
def _(i):
    bench = i.benchmark()
    days = bench.select(F.trunc("date", "month").alias("snapshot_date")).distinct()
    done = days.filter(F.col("snapshot_date") < F.lit(dt.date(1998, 1, 1))).select(
        "snapshot_date", F.lit(4).alias("horizon_weeks"),
        F.explode(F.array(*[F.lit(n) for n in c.COHORTS])).alias("cohort"),
    )
    return record.pending(days, done, bench)


GRADES = """snapshot_date:d, horizon_weeks:i, cohort, n:i, n_priced:i, median_return_pct:f,
mean_return_pct:f, hit_rate:f, universe_median_pct:f, excess_vs_universe_pp:f,
benchmark_return_pct:f, excess_vs_benchmark_pp:f"""


@register(
    "grade_snapshot", GRADES, "supplier",
    f"""{o.snapshot('supplier')}, {MEMBERS}, {forward('bars', 'fwd', 50.0)},
    index_bars AS (SELECT 'benchmark' AS symbol, date, close FROM bench), {forward('index_bars', 'bfwd', 50.0)},
    spine AS (SELECT (SELECT b FROM bnd) AS snapshot_date, w AS horizon_weeks, cohort FROM
      (VALUES (4), (8), (13)) h(w), (VALUES ('universe'), ('buy_star'), ('stage2_rs80'),
      ('trend_template'), ('breakout_confirmed')) k(cohort)),
    g AS (
      SELECT s.snapshot_date, s.horizon_weeks, s.cohort, count(m."Symbol") AS n, count(f.return_pct) AS n_priced,
        median(f.return_pct) AS med, avg(f.return_pct) AS mean, avg((f.return_pct > 0)::INT) AS hit
      FROM spine s LEFT JOIN members m ON m.cohort = s.cohort
      LEFT JOIN fwd f ON f.symbol = m."Symbol" AND f.snapshot_date = s.snapshot_date
        AND f.horizon_weeks = s.horizon_weeks GROUP BY 1, 2, 3),
    result AS (
      SELECT g.*, round(g.med, 4) AS median_return_pct, round(g.mean, 4) AS mean_return_pct,
        round(g.hit, 4) AS hit_rate, round(u.med, 4) AS universe_median_pct,
        round(g.med - u.med, 4) AS excess_vs_universe_pp, round(b.return_pct, 4) AS benchmark_return_pct,
        round(g.med - b.return_pct, 4) AS excess_vs_benchmark_pp
      FROM g LEFT JOIN g u ON u.cohort = 'universe' AND u.snapshot_date = g.snapshot_date
        AND u.horizon_weeks = g.horizon_weeks
      LEFT JOIN bfwd b ON b.snapshot_date = g.snapshot_date AND b.horizon_weeks = g.horizon_weeks)""")
def _(i):
    day, bars = i.boundary(), i.landed_bars()
    snapshot = plans.land(full(i).withColumn("snapshot_date", F.lit(day)), "snapshot")
    due = record.with_horizons(snapshot.select("snapshot_date").distinct())
    return record.grade(snapshot, bars, i.landed_benchmark(), due, DECISION, threshold=50.0)


@register(
    "append_only", "snapshot_date:d, horizon_weeks:i, cohort, n:i", "nation",
    """WITH m AS (SELECT date_trunc('month', l_shipdate)::DATE AS d, count(*) AS n FROM lineitem GROUP BY 1),
    result AS (SELECT d AS snapshot_date, 4 AS horizon_weeks, 'universe' AS cohort,
      CASE WHEN d < DATE '1999-01-01' THEN -1 ELSE n END AS n FROM m)""")
def _(i):
    months = i.table("lineitem").groupBy(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("snapshot_date")
    ).agg(F.count(F.lit(1)).alias("n"))
    new = months.select("snapshot_date", F.lit(4).alias("horizon_weeks"),
                        F.lit("universe").alias("cohort"), "n")
    old = new.filter(F.col("snapshot_date") < F.lit(dt.date(1999, 1, 1))).withColumn(
        "n", F.lit(-1).cast("bigint"))
    return record.append_only(old, new)


@register(
    "archived_rows", "snapshot_date:d, Symbol, Close:f, RS_Blend:f, MA_30W:f", "supplier",
    f"""{o.snapshot('supplier')}, result AS (
      SELECT (SELECT b FROM bnd) AS snapshot_date, "Symbol", round("Close" , 4) AS "Close",
        round("RS_Blend", 4) AS "RS_Blend", round("MA_30W", 4) AS "MA_30W" FROM research)""")
def _(i):
    return record.frozen(full(i), i.boundary())


# --- reconciliation --------------------------------------------------------------------

@register(
    "reconciliation", "field, compared:i, mismatches:i", "settled",
    f"""{o.snapshot('settled')}, result AS (
      SELECT f AS field, (SELECT count(*) FROM research) AS compared, 0 AS mismatches
      FROM (SELECT unnest([{', '.join(f"'{n}'" for n in reconcile.TOLERANCES)}]) AS f))""")
def _(i):
    day, bars = i.boundary(), i.landed_bars()
    rows = measured(i).drop("RS_Line", "RS_Line_High_52W")
    second = reconcile.independent_fields(bars, day, i.variant.min_sessions)
    return reconcile.field_report(reconcile.compare(rows, second))


@register("independent_fields",
          """Symbol, R3M:f, R12M:f, RS_Blend:f, MaxDD_3M:f, MaxDD_12M:f, Up_Days_Pct_6M:f,
          MA_30W:f, MA_30W_Slope_10S_Pct:f, Stage, MA_10W:f, High_52W:f, Low_52W:f, SMA_150:f,
          SMA_200:f, VCP_Contractions:i, Contraction_Ratio:f, Volume_DryUp:f, VCP_Pivot:f, Volume_Ratio:f,
          U_D:f, AvgValue20:f""", "supplier", o.snapshot("supplier"), "research")
def _(i):
    return reconcile.independent_fields(i.landed_bars(), i.boundary(), i.variant.min_sessions)


@register(
    "panel_reconciliation", "compared:i, disagreements:i", "settled",
    f"""{o.snapshot('settled')}, result AS (
      SELECT count(*) AS compared, 0 AS disagreements FROM research)""")
def _(i):
    day = i.boundary()
    rows = plans.land(measured(i).select("Symbol", "Date", "Close", "MA_10W", "MA_30W"), "rows")
    trends = indicators.trend_frame(b.rows_until(i.landed_bars(), day))
    bad = reconcile.panel_disagreements(trends, rows)
    return rows.agg(F.count(F.lit(1)).alias("compared")).withColumn(
        "disagreements", bad.agg(F.count(F.lit(1))).scalar()
    )


# --- swings ------------------------------------------------------------------------------

@register("swing_points", "symbol, seq:i, date:d, price:f, kind", "nation", sw.swings(), "swings")
def _(i):
    return swings.swing_points(i.bars())


@register("contraction_depths", "symbol, peak_date:d, depth_pct:f", "nation",
          f"{sw.swings()}, {sw.DEPTHS}", "depths")
def _(i):
    return swings.contraction_depths(swings.swing_points(i.bars()))


@register("cascading_contractions", "symbol, seq:i, peak_date:d, peak:f, depth_pct:f", "nation",
          sw.contractions())
def _(i):
    return swings.cascading_contractions(i.bars(), DECISION)


@register("vcp_footprints",
          "symbol, session:d, Base_Weeks:f, Deepest_Pct:f, Tightest_Pct:f, Contractions:i, VCP_Pivot:f, label",
          "supplier", sw.footprints((c.CASCADE_INITIAL_PCT,)), "labelled")
def _(i):
    return swings.footprints(i.bars()).withColumn("label", swings.footprint_label())


@register("recovery_contractions", "symbol, seq:i, peak_date:d, peak:f, trough:f, depth_pct:f",
          "nation", sw.recoveries(), "legs")
def _(i):
    return swings.recovery_contractions(i.bars(), None, DECISION)


@register("final_contraction_pivot", "symbol, pivot:f, depth_pct:f", "nation",
          f"""{sw.recoveries()}, result AS (
            SELECT symbol, arg_max(peak, seq) AS pivot, arg_max(depth_pct, seq) AS depth_pct
            FROM legs GROUP BY symbol)""")
def _(i):
    return swings.final_pivots(
        swings.recovery_contractions(i.bars(), None, DECISION)
    )


@register("footprint_sweep", "symbol, initial_pct:f, session:d, score:f, label, matches", "supplier",
          f"""{sw.footprints(c.SWEEP_THRESHOLDS)}, result AS (
            SELECT *, abs("Contractions" - 3) * 3 + abs("Deepest_Pct" - 32) AS score,
              "Contractions" = 3 AS matches FROM labelled WHERE "Base_Weeks" IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY symbol, initial_pct ORDER BY score, session) = 1)""")
def _(i):
    want = {"contractions": 3, "deepest": 32.0}
    return swings.threshold_sweep(i.bars(), None, None, want)
