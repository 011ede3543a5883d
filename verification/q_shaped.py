"""Queries over the shaped variant, where every rule, label and list has its case."""

from __future__ import annotations

import datetime as dt

from breadthline.operators import boundary as b
from breadthline.operators import corporate, guards
from breadthline.plans import audit
from breadthline.session import land
from verification import oracle_base as o
from verification.inputs import DECISION
from verification.q_changes import events
from verification.q_indicators import full, measured
from verification.registry import QUERIES, register

#: Queries over a snapshot whose data seldom or never takes the branches they show.
REPEATED = (
    "research", "trend_flags", "high_low_52w", "rs_line_leads_price", "vcp_base", "trend_template",
    "stage1_readiness", "action", "action_reason", "screen_presets", "screen_exit_now",
    "screen_liquid", "setup_groups", "setups_closest_to_pivot", "shelf_rs_leadership",
    "shelf_timing_warnings", "leader_board", "setup_board", "cohort_members", "action_distribution",
    "industry_leadership",
)

for _name in REPEATED:
    _query = QUERIES[_name]
    _plain = o.snapshot(_query.variant)
    assert _query.ctes.startswith(_plain), _name
    register(f"shaped_{_name}", _query.columns, "shaped",
             o.snapshot("shaped") + _query.ctes.removeprefix(_plain), _query.source)(_query.build)


@register(
    "shaped_session_trading", "date:d, known:i, traded:i, closed", "shaped",
    f"""WITH {o.bars('shaped')}, result AS (
      SELECT date, count(volume) AS known, count(*) FILTER (WHERE volume > 0) AS traded,
        count(volume) >= 20 AND count(*) FILTER (WHERE volume > 0) / count(volume) < 0.05 AS closed
      FROM bars GROUP BY date)""")
def _(i):
    return b.session_trading(i.bars())


@register(
    "shaped_audit_excluded", "symbol, reason", "shaped",
    f"""WITH {o.bars('shaped')}, doubled AS (
      SELECT symbol, date FROM bars UNION ALL
      SELECT symbol, date FROM bars WHERE symbol = 'SHAPE_19' AND day(date) = 1),
    bad AS (SELECT DISTINCT symbol FROM (
      SELECT symbol FROM doubled GROUP BY symbol, date HAVING count(*) > 1)),
    clean AS (SELECT * FROM bars WHERE symbol NOT IN (SELECT symbol FROM bad)
      AND symbol NOT IN ('SHAPE_20', 'SHAPE_21')),
    {o.boundary('shaped').replace("FROM bars", "FROM clean")}, result AS (
      SELECT u."Symbol" AS symbol, CASE
        WHEN u."Symbol" IN (SELECT symbol FROM bad) THEN 'Duplicate market-data sessions detected'
        WHEN k.symbol IS NULL THEN 'the provider returned no history'
        ELSE 'no completed session at the global boundary ' || (SELECT b FROM bnd)::VARCHAR
          || '; its latest is ' || k.d::VARCHAR END AS reason
      FROM universe u LEFT JOIN (
        SELECT symbol, max(date) FILTER (WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)) AS d
        FROM clean GROUP BY symbol) k ON k.symbol = u."Symbol"
      WHERE k.d IS NULL OR k.d <> (SELECT b FROM bnd))""")
def _(i):
    """A doubled history, two that are missing, and one that ends early."""
    bars, names = i.landed_bars(), i.universe()
    some = bars.where("symbol NOT IN ('SHAPE_20', 'SHAPE_21')").unionByName(
        bars.where("symbol = 'SHAPE_19' AND day(date) = 1"))
    clean, rejected = audit.admitted(some, names)
    day = b.information_boundary(clean, names.count(), DECISION, i.variant.min_pct)
    return b.unavailable(names.withColumnRenamed("Symbol", "symbol"), clean, day, rejected)


@register(
    "shaped_corporate_action_flags",
    "Symbol, Corporate_Action, Corporate_Action_Date, Corporate_Action_Kind", "shaped",
    f"""{o.snapshot('shaped')}, ratios AS (
      SELECT symbol, date, close, lag(close) OVER w AS prev, close / lag(close) OVER w AS ratio
      FROM bars WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)
      WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    {events(0.35, "(SELECT b FROM bnd) - 364")}, newest AS (
      SELECT "Symbol", max("Date") AS d, arg_max("Looks_Like", "Date") AS k FROM events GROUP BY 1),
    result AS (
      SELECT r."Symbol", n.d IS NOT NULL AS "Corporate_Action",
        coalesce(strftime(n.d, '%Y-%m-%d'), '') AS "Corporate_Action_Date",
        coalesce(n.k, '') AS "Corporate_Action_Kind"
      FROM research r LEFT JOIN newest n ON n."Symbol" = r."Symbol")""")
def _(i):
    """Threshold and guard as the job has them."""
    found = corporate.report(i.landed_bars(), i.boundary(), i.universe().count())
    return corporate.flag_rows(measured(i), found)


def guard_sql(variant: str) -> str:
    """The guards from their definitions, at the thresholds of the job (0.35, 2 %, 15 %)."""
    return f"""{o.snapshot(variant)}, sessions AS (
      SELECT count(volume) >= 20 AND count(*) FILTER (WHERE volume > 0) / count(volume) < 0.05 AS closed
      FROM bars WHERE volume IS NOT NULL GROUP BY date),
    ratios AS (
      SELECT symbol, date, abs(close / lag(close) OVER w - 1) AS move, close / lag(close) OVER w AS ratio
      FROM bars WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)
      WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    counted AS (
      SELECT 'closed sessions' AS guard, count(*) FILTER (WHERE closed) AS count, count(*) AS total,
        floor(count(*) * 0.15) AS ceiling, count(*) >= 60 AS judged FROM sessions UNION ALL
      SELECT 'symbols without a usable history',
        count(*) FILTER (WHERE "Symbol" NOT IN (SELECT "Symbol" FROM research)), count(*),
        floor(count(*) * 0.02), true FROM universe UNION ALL
      SELECT 'symbols without any history',
        count(*) FILTER (WHERE "Symbol" NOT IN (SELECT symbol FROM bars)), count(*), 0, true
      FROM universe UNION ALL
      SELECT 'jumps in the newest session',
        (SELECT count(*) FROM ratios WHERE move > 0.35 AND ratio > 0 AND date = (SELECT b FROM bnd)),
        count(*), greatest(8, ceil(count(*) * 0.02)) - 1, true FROM research UNION ALL
      SELECT 'rows of another session', count(*) FILTER (WHERE "Date" <> (SELECT b FROM bnd)),
        count("Date"), 0, true FROM research UNION ALL
      SELECT 'later session published', 0, 1, 0, true),
    result AS (SELECT guard, count, total, ceiling, judged AND count > ceiling AS refuse FROM counted)"""


GUARDS = "guard, count:i, total:i, ceiling:i, refuse"


def all_guards(i):
    bars, day = i.landed_bars(), i.boundary()
    names = i.universe().withColumnRenamed("Symbol", "symbol")
    rows = land(full(i), "snapshot")
    return guards.table(
        guards.closed_sessions(b.session_trading(bars)),
        guards.lost_symbols(names, b.unavailable(names, bars, day)),
        guards.absent_symbols(names, bars),
        guards.newest_jumps(corporate.scan(b.rows_until(bars, day)), day, rows),
        guards.other_sessions(rows, day),
        guards.backwards(i.spark, day, day - dt.timedelta(days=1)))


for _variant in ("shaped", "nation", "supplier"):
    register(f"guards_{_variant}", GUARDS, _variant, guard_sql(_variant))(all_guards)
