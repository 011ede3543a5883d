"""The daily job: boundary, snapshot, previous snapshot, checks, then outputs.

Every check runs before the first output is written.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.operators import (
    aggregates,
    boundary,
    corporate,
    guards,
    indicators,
    reconcile,
    record,
)
from breadthline.plans.research import research
from breadthline.session import land, land_by_symbol
from breadthline.sources import panel, sinks


class AuditError(ValueError):
    """The run must not publish."""


@dataclass
class AuditResult:
    boundary: dt.date | None
    previous_boundary: dt.date | None = None
    published: bool = False
    archived: str | None = None
    notes: list[str] = field(default_factory=list)


def admitted(bars: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars of the universe without malformed symbols, and the malformed ones.

    Symbols outside the universe have no say in closed sessions or coverage; a symbol with two rows
    for one session is left out as a whole and named with its reason later.
    """
    names = universe.select(F.col("Symbol").alias("symbol"))
    inside = bars.join(names, "symbol", "left_semi")
    rejected = land(boundary.duplicate_symbols(inside), "rejected")
    return inside.join(rejected, "symbol", "left_anti"), rejected


def previous_snapshot(bars, universe, current, newest, min_pct, benchmark, min_sessions):
    """(boundary, snapshot) one covered session earlier; their absence is survivable.

    Coverage is that of the whole universe; ranked are the symbols of the current snapshot, so that
    both sides compare the same symbols with each other.
    """
    try:
        day = boundary.information_boundary(bars, universe.count(), newest, min_pct)
    except boundary.CoverageError:
        return None, None
    same = universe.join(current.select("Symbol"), "Symbol", "left_semi")
    return day, research(bars, same, day, benchmark, min_sessions)


def run_audit(
    spark: SparkSession, bars: DataFrame, universe: DataFrame, decision: dt.date, folder: str,
    benchmark: DataFrame | None = None, benchmark_ticker: str = "",
    max_loss_pct: float = c.MAX_UNIVERSE_LOSS_PCT, min_sessions: int = c.MIN_RANGE_SESSIONS,
    threshold: float = c.IMPLAUSIBLE_MOVE, start: dt.date | None = None,
) -> AuditResult:
    """Run for one decision date; raises when the outputs must not be published.

    Only bars from `start` (500 days back by default) are read: the longest
    window needs a year, and a date filter prunes the rest of the table.
    """
    decision, start, end = boundary.resolve_dates(decision, start)
    bars = bars.filter(F.col("date").between(F.lit(start), F.lit(end)))
    bars, rejected = admitted(bars, universe)
    closed = boundary.non_trading_sessions(bars)
    # Read by the coverage, both snapshots, the trends and the checks.
    bars = land_by_symbol(boundary.without_sessions(bars, closed), "bars")
    size = universe.count()
    min_pct = 100.0 - max_loss_pct
    day = boundary.information_boundary(bars, size, decision, min_pct)
    floor = sinks.published_session(spark, folder)
    if floor is not None and day < floor:
        return AuditResult(day, notes=[f"published snapshot already describes {floor}"])

    names = universe.withColumnRenamed("Symbol", "symbol")
    missing = land(boundary.unavailable(names, bars, day, rejected), "excluded")
    excluded = missing.count()
    if refused := guards.refusals(guards.lost_symbols(names, missing, max_loss_pct)):
        raise boundary.CoverageError(refused[0])

    current = land(research(bars, universe, day, benchmark, min_sessions), "research")
    before, previous = previous_snapshot(
        bars, universe, current, day, min_pct, benchmark, min_sessions)
    inside = boundary.rows_until(bars, day).join(
        current.selectExpr("Symbol AS symbol"), "symbol", "left_semi"
    )
    trends = land(indicators.trend_frame(inside, c.PANEL_SESSIONS), "trends")

    second = reconcile.independent_fields(inside, day, min_sessions)
    wrong = reconcile.mismatches(reconcile.compare(current, second)).take(100)
    wrong += reconcile.panel_disagreements(trends, current).take(100)
    complaints = [str(row) for row in wrong] + boundary.one_date(current, day)
    if (reason := panel.panel_matches(trends, current)) is not None:
        complaints.append(reason)
    if complaints:
        raise AuditError("reconciliation failures:\n" + "\n".join(complaints[:100]))

    events = land(corporate.report(inside, day, 0, threshold, guard=False), "events")
    checked = land(guards.table(
        guards.closed_sessions(boundary.session_trading(bars)),
        guards.lost_symbols(names, missing, max_loss_pct), guards.absent_symbols(names, bars),
        guards.newest_jumps(events, day, current), guards.other_sessions(current, day),
        guards.backwards(spark, day, floor)), "guards")
    # Symbols without bars are reported; only their share of the universe refuses the run.
    refused = guards.refusals(checked.filter(F.col("guard") != guards.ABSENT))
    if refused:
        kind = corporate.MassEventError if refused[0].startswith(guards.JUMPS) else AuditError
        raise kind("the run must not publish: " + "; ".join(refused))
    current = corporate.flag_rows(current, events)
    history = aggregates.breadth_history(trends, c.BREADTH_SESSIONS)
    if benchmark is not None:
        history = aggregates.with_benchmark_column(history, benchmark, benchmark_ticker)

    result = AuditResult(day, before)
    run = sinks.Publication(spark, folder)
    run.write(current, "research")
    run.write(missing, "excluded")
    run.write(checked, "guards")
    run.write(events, "corporate_actions")
    if previous is not None:
        run.write(
            corporate.flag_rows(previous, corporate.report(inside, before, current.count(), threshold)),
            "previous",
        )
    else:
        result.notes.append("no earlier session covers the universe; changes are unavailable")
    run.write(history, "breadth")
    panel.write_panel(panel.panel_of(trends), run.path("panel"))
    run.write(boundary.maturing(current, inside, day, min_sessions), "maturing")
    result.published = run.commit(day)
    if not result.published:
        result.notes.append("another run published a later session meanwhile")
        return result
    result.archived = record.archive_snapshot(current, f"{folder}/snapshots", day)
    result.notes.append(f"{excluded} of {size} symbols without a close at {day}")
    return result
