"""Per-symbol indicators at the last session, and moving-average series.

The snapshot needs each indicator at one session only, so nothing here slides a
window over every row. Rows are read newest first: with that order every window
the method asks for ("from the last session on or before t - k, to t") is the
set of rows whose *newer* neighbour lies after t - k, and the deepest fall from
a row is the running minimum seen so far. All frames are therefore running
frames, linear in the number of rows, and share one shuffle and one sort by
symbol; the indicators themselves are conditional aggregates over the result.

A symbol's group holds at most one row per session of the calendar, whatever
the number of trades behind it, so one symbol always fits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules
from breadthline.functions.exact import exact_mean, exact_sum
from breadthline.functions.windows import by_symbol, newer, newest_first, oldest_first, so_far, up_to_here

SERIES = ("close", "high", "low", "line")


def with_benchmark(bars: DataFrame, benchmark: DataFrame | None) -> DataFrame:
    """Attach the benchmark close of the same date; no date is filled.

    The benchmark has one row per session, so the optimizer broadcasts it once
    it has measured it below its threshold and shuffles it otherwise.
    """
    if benchmark is None:
        return bars.withColumn("line", F.lit(None).cast("double"))
    index = benchmark.select("date", F.col("close").alias("benchmark_close"))
    usable = F.col("close").isNotNull() & (F.col("benchmark_close") != 0)
    return bars.join(index, "date", "left").withColumn(
        "line", F.when(usable, F.try_divide("close", "benchmark_close"))
    )


def session_facts(bars: DataFrame) -> DataFrame:
    """Per row: its position from the end and its newer neighbour, per series."""
    low = "low" if "low" in bars.columns else "CAST(NULL AS double) AS low"
    facts = bars.selectExpr(
        "symbol", "date", "close", "high", low, "volume", "line",
        "unix_date(date) AS day", "close * volume AS value",
    )
    first_layer = {
        "pos": F.row_number().over(newest_first()) - 1,
        "prior_row_close": F.lead("close").over(newest_first()),
        "newer_close": F.last("close", ignorenulls=True).over(newer()),
        "close_pos": F.count("close").over(so_far()) - 1,
        "value_pos": F.count("value").over(so_far()) - 1,
        "trough": F.min("close").over(so_far()),
    }
    for s in SERIES:
        known = F.expr(f"CASE WHEN {s} IS NOT NULL THEN day END")
        first_layer[f"{s}_end"] = F.first(known, ignorenulls=True).over(so_far())
        first_layer[f"{s}_newer"] = F.last(known, ignorenulls=True).over(newer())
    facts = facts.withColumns(first_layer).withColumn("true_range", F.expr(
        "greatest(high - low, abs(high - prior_row_close), abs(low - prior_row_close))"
    ))
    slope_row = F.expr(
        f"CASE WHEN close IS NOT NULL AND close_pos = {c.SLOPE_SESSIONS} THEN day END"
    )
    return facts.withColumns({
        "tr_pos": F.count("true_range").over(so_far()) - 1,
        "slope_day": F.first(slope_row, ignorenulls=True).over(so_far()),
    })


# The expressions below are SQL text: a hundred of them as Column calls would spend
# more time between Python and the JVM than a small snapshot takes to compute.

def _months_back(months: int, end: str = "close_end") -> str:
    return f"unix_date(add_months(date_from_unix_date({end}), -{months}))"


def _inside(series: str, since: str) -> str:
    """Row belongs to the as-of window that starts at the last session on or before `since`."""
    return f"{series} IS NOT NULL AND ({series}_newer IS NULL OR {series}_newer > {since})"


def _latest(n: int, position: str = "pos", skip: int = 0) -> str:
    return f"{position} BETWEEN {skip} AND {skip + n - 1}"


def _agg(function: str, value: str, condition: str) -> str:
    return f"{function}(CASE WHEN {condition} THEN {value} END)"


def _input_expressions() -> dict[str, str]:
    long_days, short_days = 7 * c.WEEKS_LONG_MA, 7 * c.WEEKS_SHORT_MA
    base = _latest(c.BASE_SESSIONS)
    in_ud = _latest(c.UD_SESSIONS)
    prior_ma = f"{_inside('close', f'slope_day - {long_days}')} AND close_pos >= {c.SLOPE_SESSIONS}"
    out = {
        "close_day": "max(close_end)",
        "first_close_day": _agg("min", "day", "close IS NOT NULL"),
        "slope_day": "max(slope_day)",
        "rows": "count(1)",
        "closes": "count(close)",
        "values": "count(value)",
        "close_now": _agg("max", "close", "day = close_end"),
        "volume_now": _agg("max", "volume", "pos = 0"),
        "ma_long": exact_mean("close", _inside("close", f"close_end - {long_days}")),
        "ma_long_prior": exact_mean("close", prior_ma),
        "ma_short": exact_mean("close", _inside("close", f"close_end - {short_days}")),
        "volume_base": exact_mean("volume", _latest(c.VOLUME_BASELINE, skip=1)),
        "up_volume": exact_sum("volume", f"{in_ud} AND close - prior_row_close > 0"),
        "down_volume": exact_sum("volume", f"{in_ud} AND close - prior_row_close < 0"),
        "value_mean": exact_mean("value", _latest(c.VALUE_SESSIONS, "value_pos")),
        "tr_rows": "count(true_range)",
        "tr_mean": exact_mean("true_range", _latest(c.ATR_SESSIONS, "tr_pos")),
        "dry_recent": exact_mean("volume", _latest(c.DRYUP_RECENT)),
        "dry_base": exact_mean("volume", _latest(c.DRYUP_BASELINE, skip=c.DRYUP_RECENT)),
        "base_high": _agg("max", "high", base),
        "base_low": _agg("min", "low", base),
    }
    for n in (50, 150, 200):
        out[f"sma_{n}"] = exact_mean("close", _latest(n, "close_pos"))
    out["sma_200_prior"] = exact_mean("close", _latest(200, "close_pos", c.SMA_RISING_SESSIONS)
    )
    for m in c.RETURN_MONTHS:
        inside = _inside("close", _months_back(m))
        out[f"reference_{m}"] = _agg("max", "close", f"{inside} AND day <= {_months_back(m)}")
        out[f"fall_{m}"] = _agg("min", "try_divide(trough, close) - 1.0D", inside)
    half_year = _inside("close", _months_back(c.UP_DAYS_MONTHS))
    out["half_year_rows"] = f"count_if({half_year})"
    out["half_year_ups"] = f"count_if({half_year} AND newer_close > close)"
    for s, extreme in (("high", "max"), ("low", "min"), ("line", "max")):
        inside = _inside(s, f"{s}_end - {7 * c.WEEKS_RANGE}")
        out[f"{s}_day"] = f"max({s}_end)"
        out[f"first_{s}_day"] = _agg("min", "day", f"{s} IS NOT NULL")
        out[f"range_{s}"] = _agg(extreme, s, inside)
        out[f"range_{s}_rows"] = f"count_if({inside})"
    out["line_now"] = _agg("max", "line", "day = line_end")
    size = c.BASE_SESSIONS // c.BASE_BLOCKS
    for b in range(c.BASE_BLOCKS):
        block = _latest(size, skip=(c.BASE_BLOCKS - 1 - b) * size)
        out[f"block_{b}_high"] = _agg("max", "high", block)
        out[f"block_{b}_low"] = _agg("min", "low", block)
        out[f"block_{b}_mean"] = exact_mean("close", block)
    return out


def indicator_inputs(facts: DataFrame) -> DataFrame:
    """One row per symbol: every conditional aggregate the indicators need.

    Position columns count only rows that have the value: a row without a close
    repeats the position of the newer row, and its NULL close enters no average.
    """
    return facts.groupBy("symbol").agg(
        *[F.expr(e).alias(n) for n, e in _input_expressions().items()]
    )


def _ratio_or_infinity(part: str, base: str) -> str:
    """part/base; over a zero base a positive part is infinite and zero is undefined."""
    return (
        f"CASE WHEN {base} = 0 THEN CASE WHEN {part} > 0 THEN double('Infinity') END "
        f"ELSE try_divide({part}, {base}) END"
    )


def _reaches_back(series: str, end: str, days: int) -> str:
    return f"first_{series}_day <= {end} - {days}"


def _range(series: str, min_sessions: int) -> str:
    reaches = _reaches_back(series, f"{series}_day", 7 * c.WEEKS_RANGE)
    return f"CASE WHEN range_{series}_rows >= {min_sessions} AND {reaches} THEN range_{series} END"


def range_blocks() -> str:
    """Five (max high - min low) / mean close percentages of the base, oldest first."""
    usable = " AND ".join(f"coalesce(block_{b}_mean <> 0, false)" for b in range(c.BASE_BLOCKS))
    spans = ", ".join(
        f"try_divide(block_{b}_high - block_{b}_low, block_{b}_mean) * 100.0D"
        for b in range(c.BASE_BLOCKS)
    )
    return f"CASE WHEN rows >= {c.BASE_SESSIONS} AND {usable} THEN array({spans}) END"


def _field_expressions(min_sessions: int, has_low: bool) -> dict[str, str]:
    long_days = 7 * c.WEEKS_LONG_MA
    complete = " AND ".join(f"reference_{m} IS NOT NULL" for m in c.RETURN_MONTHS)
    raw = {m: f"(try_divide(close_now, reference_{m}) - 1.0D)" for m in c.RETURN_MONTHS}
    blend = " + ".join(f"{c.BLEND_WEIGHTS[m]}D * {raw[m]}" for m in c.RETURN_MONTHS)
    line = (
        f"{_reaches_back('close', 'close_day', long_days)} "
        f"AND {_reaches_back('close', 'slope_day', long_days)} AND ma_long_prior <> 0"
    )
    half_year = f"first_close_day <= {_months_back(c.UP_DAYS_MONTHS, 'close_day')}"
    deep = f"rows >= {c.BASE_SESSIONS} AND base_high > 0"
    out = {
        "Symbol": "symbol",
        "Date": "date_from_unix_date(close_day)",
        "Close": "close_now",
        **{f"R{m}M": f"CASE WHEN {complete} THEN {raw[m]} END" for m in c.RETURN_MONTHS},
        "RS_Blend": f"CASE WHEN {complete} THEN {blend} END",
        **{
            f"MaxDD_{m}M": f"CASE WHEN first_close_day <= {_months_back(m, 'close_day')} "
                           f"THEN fall_{m} END"
            for m in c.RETURN_MONTHS
        },
        "Up_Days_Pct_6M": f"CASE WHEN {half_year} THEN "
                          "try_divide(double(half_year_ups), double(half_year_rows - 1)) * 100.0D END",
        "MA_30W": f"CASE WHEN {line} THEN ma_long END",
        "MA_30W_Slope_10S_Pct": f"CASE WHEN {line} THEN "
                                "(try_divide(ma_long, ma_long_prior) - 1.0D) * 100.0D END",
        "MA_10W": f"CASE WHEN {_reaches_back('close', 'close_day', 7 * c.WEEKS_SHORT_MA)} "
                  "THEN ma_short END",
        "High_52W": _range("high", min_sessions),
        "Low_52W": _range("low", min_sessions),
        "Volume_Ratio": f"CASE WHEN rows > {c.VOLUME_BASELINE} THEN "
                        f"{_ratio_or_infinity('volume_now', 'volume_base')} END",
        "U_D": f"CASE WHEN rows > {c.UD_SESSIONS} THEN "
               + _ratio_or_infinity("coalesce(up_volume, 0.0D)", "coalesce(down_volume, 0.0D)")
               + " END",
        "AvgValue20": f"CASE WHEN values >= {c.VALUE_SESSIONS} THEN value_mean END",
        **{f"SMA_{n}": f"CASE WHEN closes >= {n} THEN sma_{n} END" for n in (50, 150, 200)},
        "SMA_200_Rising": f"coalesce(closes >= {200 + c.SMA_RISING_SESSIONS} "
                          "AND sma_200 > sma_200_prior, false)",
        "Range_Blocks": range_blocks(),
        "RS_Line": "line_now",
        "RS_Line_High_52W": _range("line", min_sessions),
        "ATR_Pct": f"CASE WHEN {str(has_low).lower()} AND tr_rows >= {c.ATR_SESSIONS} THEN "
                   "try_divide(tr_mean, close_now) * 100.0D END",
        "Base_Depth_Pct": f"CASE WHEN {deep} THEN (base_high - base_low) / base_high * 100.0D END",
        "Volume_DryUp": f"CASE WHEN rows >= {c.DRYUP_RECENT + c.DRYUP_BASELINE} THEN "
                        "try_divide(dry_recent, dry_base) END",
        "VCP_Pivot": f"CASE WHEN rows >= {c.BASE_SESSIONS} THEN base_high END",
    }
    return out


def symbol_indicators(
    bars: DataFrame,
    benchmark: DataFrame | None = None,
    min_sessions: int = c.MIN_RANGE_SESSIONS,
) -> DataFrame:
    """Every field of a snapshot row that needs no other symbol.

    `bars` must already end at the session to be measured (see
    `boundary.rows_until`); a row's newest session is its snapshot session.
    """
    inputs = indicator_inputs(session_facts(with_benchmark(bars, benchmark)))
    fields = _field_expressions(min_sessions, "low" in bars.columns)
    rows = inputs.selectExpr(*[f"{e} AS {n}" for n, e in fields.items()])
    tighter = " + ".join(
        f"int(coalesce(Range_Blocks[{b}] < Range_Blocks[{b - 1}], false))"
        for b in range(1, c.BASE_BLOCKS)
    )
    rows = rows.selectExpr(
        "*",
        f"{tighter} AS VCP_Contractions",
        f"try_divide(Range_Blocks[{c.BASE_BLOCKS - 1}], Range_Blocks[0]) AS Contraction_Ratio",
        f"{rules.STAGE} AS Stage",
        f"{rules.NEAR_HIGH} AS Near_52W_High",
        f"{rules.LINE_AT_HIGH} AS RS_Line_At_High",
        "(try_divide(VCP_Pivot, Close) - 1.0D) * 100.0D AS Pct_To_Pivot",
        *[f"{e} AS {n}" for n, e in {**rules.TIMING, **rules.TREND}.items()],
    )
    return rows.selectExpr(
        "*",
        f"{rules.BREAKOUT} AS Breakout",
        f"{rules.BREAKOUT_CONFIRMED} AS Breakout_Confirmed",
        f"{rules.VCP_SETUP} AS VCP_Setup",
    )


# --- series --------------------------------------------------------------------

def calendar_mean(rows: DataFrame, value: str, weeks: int, name: str) -> DataFrame:
    """The as-of calendar mean at every session, from running sums.

    The window sum is the difference of two running sums, so the cost per row
    does not grow with the window. Sums run over differences to the symbol's
    first value: a flat series then gives exactly its own level, and the sums
    stay small.
    """
    days = 7 * weeks
    run = up_to_here()
    start = oldest_first().rangeBetween(Window.unboundedPreceding, -days)
    v = F.col(value)
    rows = rows.withColumn("_origin", F.first(v, ignorenulls=True).over(run))
    rows = rows.withColumns({
        "_sum": F.sum(v - F.col("_origin")).over(run),
        "_count": F.count(v).over(run),
    })
    before = F.when(
        v.isNotNull(),
        F.struct(
            (F.col("_sum") - (v - F.col("_origin"))).alias("total"),
            (F.col("_count") - 1).alias("n"),
        ),
    )
    rows = rows.withColumn("_start", F.last(before, ignorenulls=True).over(start))
    mean = F.col("_origin") + (F.col("_sum") - F.col("_start.total")) / (
        F.col("_count") - F.col("_start.n")
    )
    return rows.withColumn(
        name, F.when(v.isNotNull() & F.col("_start").isNotNull(), mean)
    ).drop("_origin", "_sum", "_count", "_start")


def moving_averages(bars: DataFrame) -> DataFrame:
    """bars with MA_10W and MA_30W at every session that has a close."""
    rows = bars.withColumn("day", F.unix_date("date"))
    rows = calendar_mean(rows, "close", c.WEEKS_SHORT_MA, "ma_10w")
    rows = calendar_mean(rows, "close", c.WEEKS_LONG_MA, "ma_30w")
    return rows


def trend_frame(bars: DataFrame, sessions: int = c.PANEL_SESSIONS) -> DataFrame:
    """Close, both averages and volume of each symbol's last N sessions, and how many sessions of the
    symbol are as new (`recency`, 1 for its last one)."""
    rows = moving_averages(bars).withColumn("recency", F.row_number().over(newest_first()))
    if sessions > 0:
        rows = rows.filter(F.col("recency") <= sessions)
    return rows.select("symbol", "date", "close", "ma_10w", "ma_30w", "volume", "recency")


def session_average(bars: DataFrame, sessions: int) -> DataFrame:
    """Session-count average at every session with a close, NULL until it is full."""
    frame = oldest_first().rowsBetween(-(sessions - 1), Window.currentRow)
    rows = bars.filter(F.col("close").isNotNull()).withColumn("day", F.unix_date("date"))
    return rows.select(
        "symbol", "date", "close",
        F.when(F.count("close").over(frame) == sessions, F.avg("close").over(frame))
        .alias(f"sma_{sessions}"),
    )


def chart_series(bars: DataFrame, sessions: int = c.CHART_SESSIONS,
                 min_points: int = c.CHART_MIN_POINTS) -> DataFrame:
    """Close and averages of the last N closes; withheld for a short history."""
    rows = bars.filter(F.col("close").isNotNull())
    rows = moving_averages(rows).withColumns({
        "_recency": F.row_number().over(newest_first()),
        "_points": F.count(F.lit(1)).over(by_symbol()),
    })
    return rows.filter(
        (F.col("_points") >= min_points) & (F.col("_recency") <= sessions)
    ).select("symbol", "date", "close", "ma_10w", "ma_30w")


def candle_series(bars: DataFrame, sessions: int = c.PANEL_SESSIONS) -> DataFrame:
    """The last N rows with the 30-week line; a candle only where all prices exist.

    The line runs over the kept rows alone, as the chart that draws it does.
    """
    prices = [p for p in ("open", "high", "low", "close") if p in bars.columns]
    complete = F.lit(True)
    for p in prices:
        complete = complete & F.col(p).isNotNull()
    rows = bars.withColumn("day", F.unix_date("date"))
    rows = rows.withColumn("_recency", F.row_number().over(newest_first()))
    rows = rows.filter(F.col("_recency") <= sessions)
    rows = calendar_mean(rows, "close", c.WEEKS_LONG_MA, "ma_30w")
    return rows.select(
        "symbol", "date",
        *[F.when(complete, F.col(p)).alias(p) for p in prices],
        "ma_30w",
    )
