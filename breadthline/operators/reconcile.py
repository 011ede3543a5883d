"""A second computation of the published fields, and the comparison of both.

The snapshot is built from running window frames; this form folds over one
sorted array per symbol instead, so that an error in a frame cannot hide in
both. An array holds one element per session of one symbol.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions.numbers import INFINITY

# Tolerance per reconciled field, relative above one; None: texts, which are equal or not. Both
# computations add without an error that depends on the order, so no field needs more.
TIGHT = 1e-12
TOLERANCES: dict[str, float | None] = {
    **{f"R{m}M": TIGHT for m in c.RETURN_MONTHS},
    "RS_Blend": TIGHT,
    **{f"MaxDD_{m}M": TIGHT for m in c.RETURN_MONTHS},
    "Up_Days_Pct_6M": TIGHT,
    "MA_30W": TIGHT,
    "MA_30W_Slope_10S_Pct": TIGHT,
    "Stage": None,
    "MA_10W": TIGHT,
    "High_52W": TIGHT,
    "Low_52W": TIGHT,
    "SMA_150": TIGHT,
    "SMA_200": TIGHT,
    "VCP_Contractions": 0.0,
    "Contraction_Ratio": TIGHT,
    "Volume_DryUp": TIGHT,
    "VCP_Pivot": TIGHT,
    "Volume_Ratio": TIGHT,
    "U_D": TIGHT,
    "AvgValue20": TIGHT,
}
# The trend table runs its sums over the whole history, the snapshot over its windows.
PANEL_TOLERANCE = 1e-9
FIXED = "decimal(38,18)"


def _sum(array: Column) -> Column:
    """Added as decimals, which no order of the elements changes."""
    return F.aggregate(
        array, F.lit(0).cast(FIXED), lambda total, x: (total + x.cast(FIXED)).cast(FIXED),
        lambda total: total.cast("double"),
    )


def _mean(array: Column) -> Column:
    known = F.array_compact(array)
    return F.try_divide(_sum(known), F.size(known))


def _tail(array: Column, n: int, skip: int = 0) -> Column:
    """The n newest elements after leaving out the `skip` newest; NULL when too few."""
    size = F.size(array)
    return F.when(size >= n + skip, F.slice(array, size - n - skip + 1, F.lit(n)))


def _until(array: Column, day: Column) -> Column:
    return F.filter(array, lambda x: x["day"] <= day)


def _since(array: Column, day: Column) -> Column:
    """From the last element on or before `day` to the end; NULL when there is none."""
    position = F.size(_until(array, day))
    return F.when(
        position > 0,
        F.slice(array, F.greatest(position, F.lit(1)), F.size(array) - position + 1),
    )


def _pick(array: Column, field: str) -> Column:
    return F.transform(array, lambda x: x[field])


def _known(field: str) -> Column:
    return F.filter("history", lambda x: x[field].isNotNull())


def _deepest_fall(values: Column) -> Column:
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))
    folded = F.aggregate(
        values, start,
        lambda s, v: F.struct(
            F.greatest(s["peak"], v).alias("peak"),
            F.least(s["worst"], F.try_divide(v, F.greatest(s["peak"], v)) - 1.0).alias("worst"),
        ),
    )
    return F.when(F.size(values) >= 2, folded["worst"])


def _steps(values: Column) -> Column:
    size = F.size(values)
    return F.zip_with(
        F.slice(values, F.lit(2), F.greatest(size - 1, F.lit(0))),
        F.slice(values, F.lit(1), F.greatest(size - 1, F.lit(0))), lambda b, a: b - a,
    )


def _month_day(today: dt.date, months: int) -> Column:
    return F.unix_date(F.add_months(F.lit(today), -months))


def _line(upto: Column, weeks: int) -> Column:
    """Calendar mean as of the last element."""
    end = F.element_at(upto, -1)["day"]
    return _mean(_pick(_since(upto, end - 7 * weeks), "close"))


def _stage(price: Column, line: Column, slope: Column) -> Column:
    """The label by the side of the line the price is on, and where the line goes."""
    above, rising = (price > line).cast("int"), (slope > 0).cast("int")
    # In the order below and falling, below and rising, above and falling, above and rising.
    labels = [c.STAGE_LABELS[f"Stage {n}"] for n in (4, 1, 3, 2)]
    return F.get(F.array(*[F.lit(label) for label in labels]), 2 * above + rising)


def independent_fields(
    bars: DataFrame, boundary: dt.date, min_sessions: int = c.MIN_RANGE_SESSIONS
) -> DataFrame:
    today = F.unix_date(F.lit(boundary))
    row = F.struct(F.unix_date("date").alias("day"), "close", "high", "low", "volume")
    rows = (
        bars.filter(F.col("date") <= F.lit(boundary))
        .groupBy("symbol").agg(F.sort_array(F.collect_list(row)).alias("history"))
        .withColumns({"closes": _known("close"), "highs": _known("high"), "lows": _known("low")})
        .filter(F.element_at("closes", -1)["day"] == today)
    )
    closes = F.col("closes")
    # Windows become columns first: each is used several times below, and an
    # expression that repeats them would be folded over the array each time.
    since = {
        f"since_{m}": _pick(_since(closes, _month_day(boundary, m)), "close")
        for m in c.RETURN_MONTHS
    }
    size = F.size(closes)
    earlier = F.when(
        size > c.SLOPE_SESSIONS,
        F.slice(closes, F.lit(1), F.greatest(size - c.SLOPE_SESSIONS, F.lit(0))),
    )
    rows = rows.withColumns({
        **since,
        "earlier": earlier,
        "high_end": F.try_element_at("highs", F.lit(-1))["day"] - 7 * c.WEEKS_RANGE,
        "low_end": F.try_element_at("lows", F.lit(-1))["day"] - 7 * c.WEEKS_RANGE,
    }).withColumns({
        "long_line": _line(closes, c.WEEKS_LONG_MA),
        "short_line": _line(closes, c.WEEKS_SHORT_MA),
        "earlier_line": _line(F.col("earlier"), c.WEEKS_LONG_MA),
        "high_window": _pick(_since(F.col("highs"), F.col("high_end")), "high"),
        "low_window": _pick(_since(F.col("lows"), F.col("low_end")), "low"),
        "volumes": _pick(F.col("history"), "volume"),
    })
    now = F.element_at(closes, -1)["close"]
    fields: dict[str, Column] = {}

    past = {m: _until(closes, _month_day(boundary, m)) for m in c.RETURN_MONTHS}
    full = F.size(past[12]) > 0
    for m in c.RETURN_MONTHS:
        reference = F.try_element_at(past[m], F.lit(-1))["close"]
        fields[f"R{m}M"] = F.when(full, F.try_divide(now, reference) - 1.0)
    fields["RS_Blend"] = (
        0.40 * fields["R3M"] + 0.20 * fields["R6M"] + 0.20 * fields["R9M"] + 0.20 * fields["R12M"]
    )
    for m in c.RETURN_MONTHS:
        fields[f"MaxDD_{m}M"] = _deepest_fall(F.col(f"since_{m}"))
    steps = _steps(F.col(f"since_{c.UP_DAYS_MONTHS}"))
    fields["Up_Days_Pct_6M"] = F.try_divide(
        F.size(F.filter(steps, lambda d: d > 0)).cast("double"), F.size(steps)
    ) * 100.0
    line, before = F.col("long_line"), F.col("earlier_line")
    fields["MA_30W"] = F.when(before.isNotNull() & (before != 0), line)
    fields["MA_30W_Slope_10S_Pct"] = (F.try_divide(line, before) - 1.0) * 100.0
    fields["Stage"] = _stage(now, fields["MA_30W"], fields["MA_30W_Slope_10S_Pct"])
    fields["MA_10W"] = F.col("short_line")
    for name, window, best in (
        ("High_52W", F.col("high_window"), F.array_max), ("Low_52W", F.col("low_window"), F.array_min)
    ):
        fields[name] = F.when(F.size(window) >= min_sessions, best(window))
    for n in (150, 200):
        fields[f"SMA_{n}"] = _mean(_pick(_tail(closes, n), "close"))

    history = F.col("history")
    size = c.BASE_SESSIONS // c.BASE_BLOCKS
    spans = []
    for b in range(c.BASE_BLOCKS):
        block = F.when(
            F.size(history) >= c.BASE_SESSIONS,
            _tail(history, size, (c.BASE_BLOCKS - 1 - b) * size),
        )
        spans.append(F.try_divide(
            F.array_max(_pick(block, "high")) - F.array_min(_pick(block, "low")),
            _mean(_pick(block, "close")),
        ) * 100.0)
    means_usable = F.lit(True)
    for b in range(c.BASE_BLOCKS):
        mean = _mean(_pick(_tail(history, size, b * size), "close"))
        means_usable = means_usable & F.coalesce(mean != 0, F.lit(False))
    blocks = F.when(means_usable, F.array(*spans))
    fields["VCP_Contractions"] = F.coalesce(
        F.size(F.filter(_steps(blocks), lambda d: d < 0)), F.lit(0)
    ).cast("double")
    fields["Contraction_Ratio"] = F.try_divide(blocks[c.BASE_BLOCKS - 1], blocks[0])

    volumes = F.col("volumes")
    recent = _mean(_tail(volumes, c.DRYUP_RECENT))
    base = _mean(_tail(volumes, c.DRYUP_BASELINE, c.DRYUP_RECENT))
    fields["Volume_DryUp"] = F.try_divide(recent, base)
    fields["VCP_Pivot"] = F.array_max(_pick(_tail(history, c.BASE_SESSIONS), "high"))

    newest = F.element_at(volumes, -1)
    prior = _mean(_tail(volumes, c.VOLUME_BASELINE, 1))
    fields["Volume_Ratio"] = F.when(
        prior == 0, F.when(newest > 0, F.lit(INFINITY))
    ).otherwise(F.try_divide(newest, prior))

    days = _tail(history, c.UD_SESSIONS + 1)
    moves = F.zip_with(
        F.slice(days, F.lit(2), F.lit(c.UD_SESSIONS)),
        F.slice(days, F.lit(1), F.lit(c.UD_SESSIONS)),
        lambda b, a: F.struct((b["close"] - a["close"]).alias("step"),
                              F.coalesce(b["volume"], F.lit(0.0)).alias("volume")),
    )
    up = _sum(_pick(F.filter(moves, lambda x: x["step"] > 0), "volume"))
    down = _sum(_pick(F.filter(moves, lambda x: x["step"] < 0), "volume"))
    fields["U_D"] = F.when(down == 0, F.when(up > 0, F.lit(INFINITY))).otherwise(
        F.try_divide(up, down)
    )
    products = F.array_compact(F.transform(history, lambda x: x["close"] * x["volume"]))
    fields["AvgValue20"] = _mean(_tail(products, c.VALUE_SESSIONS))
    return rows.select(F.col("symbol").alias("Symbol"), *[v.alias(n) for n, v in fields.items()])


def compare(
    actual: DataFrame, expected: DataFrame, tolerances: dict[str, float | None] = TOLERANCES,
    key: str = "Symbol",
) -> DataFrame:
    """One row per key and field: both values as text, how far apart they are, and whether they agree.

    Two missing values agree; a column that one side lacks does not. `gap` is the difference over
    the expected value, or over one where that is smaller; texts have none.
    """
    def kind(name: str) -> str:
        return "string" if tolerances[name] is None else "double"

    def side(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select(
            key, F.lit(True).alias(f"{prefix}known"),
            *[
                (F.col(n) if n in rows.columns else F.lit(None)).cast(kind(n)).alias(f"{prefix}{n}")
                for n in tolerances
            ],
        )

    both = side(actual, "a_").join(side(expected, "e_"), key, "full_outer")
    present = {n: n in actual.columns and n in expected.columns for n in tolerances}
    checks = []
    for n, tolerance in tolerances.items():
        a, e = F.col(f"a_{n}"), F.col(f"e_{n}")
        same = (a.isNull() & e.isNull()) | (a == e)
        gap = F.lit(None).cast("double")
        if tolerance is not None:
            # Two infinite values are equal and have no distance.
            gap = F.when(a == e, 0.0).otherwise(F.abs(a - e) / F.greatest(F.lit(1.0), F.abs(e)))
            same = same | (gap <= tolerance)
        agrees = (
            F.coalesce(same, F.lit(False)) & F.lit(present[n])
            & F.col("a_known").isNotNull() & F.col("e_known").isNotNull()
        )
        checks.append(F.struct(
            F.lit(n).alias("field"), a.cast("string").alias("actual"),
            e.cast("string").alias("expected"), gap.alias("gap"), agrees.alias("agrees"),
        ))
    return both.select(key, F.inline(F.array(*checks)))


def mismatches(compared: DataFrame) -> DataFrame:
    return compared.filter(~F.col("agrees")).drop("agrees")


def field_report(compared: DataFrame) -> DataFrame:
    """Per field: rows compared, rows with a value, disagreements, and the largest gap."""
    return compared.groupBy("field").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count("expected").alias("measured"),
        F.count_if(~F.col("agrees")).alias("mismatches"),
        F.max("gap").alias("largest_gap"),
    )


def loosest(report: DataFrame) -> DataFrame:
    """The field whose values lie furthest apart: one row, none where nothing was measured."""
    return report.filter(F.col("largest_gap").isNotNull()).orderBy(
        F.desc("largest_gap"), "field").limit(1)


def panel_disagreements(trends: DataFrame, research: DataFrame) -> DataFrame:
    """Symbols whose last trend row is not the snapshot row it belongs to."""
    newest = trends.groupBy("symbol").agg(
        F.max(F.struct("date", "close", "ma_10w", "ma_30w")).alias("last")
    )
    joined = newest.join(
        research.select(F.col("Symbol").alias("symbol"), "Date", "Close", "MA_10W", "MA_30W"),
        "symbol",
    )

    def off(stored: str, reported: str) -> Column:
        gap = F.abs(F.col(f"last.{stored}") - F.col(reported)) > PANEL_TOLERANCE * F.greatest(
            F.lit(1.0), F.abs(F.col(reported))
        )
        return F.col(reported).isNotNull() & F.coalesce(gap, F.lit(True))

    problems = F.array_compact(F.array(
        F.when(F.col("last.date") != F.col("Date"), "date"),
        F.when(off("close", "Close"), "Close"),
        F.when(off("ma_10w", "MA_10W"), "MA_10W"),
        F.when(off("ma_30w", "MA_30W"), "MA_30W"),
    ))
    return joined.select("symbol", F.explode(problems).alias("field"))
