"""Breadth, regimes, industries and distributions over a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules
from breadthline.functions.numbers import flag, number, share_pct
from breadthline.operators.indicators import trend_frame
from breadthline.operators.ranking import medians, value_counts
from breadthline.session import land


def count_flag(rows: DataFrame, name: str) -> Column:
    """Rows with the flag set; a flag the snapshot does not carry counts zero."""
    return F.count_if(flag(F.col(name))) if name in rows.columns else F.lit(0).cast("bigint")


def above_long_line(rows: DataFrame) -> Column:
    """The published flag, or what the stage already says when there is none."""
    if "Above_MA_30W" in rows.columns:
        return flag(F.col("Above_MA_30W"))
    return flag(rules.stage_key("Stage").isin("Stage 2", "Stage 3"))


def classified() -> Column:
    return flag(rules.stage_key("Stage").isin(*c.STAGES))


def _regime_text(label: Column) -> Column:
    text = F.lit(c.REGIMES["Unavailable"])
    for name in ("Broad", "Mixed", "Narrow"):
        text = F.when(label == name, c.REGIMES[name]).otherwise(text)
    return text


def breadth_snapshot(rows: DataFrame) -> DataFrame:
    """One row of participation counts; shares are over classified rows."""
    has_short = "Above_MA_10W" in rows.columns
    counts = {
        "symbols": F.count(F.lit(1)),
        "classified": F.count_if(classified()),
        "above_ma_30w": F.count_if(above_long_line(rows)),
        "above_ma_10w": count_flag(rows, "Above_MA_10W"),
        "near_52w_high": count_flag(rows, "Near_52W_High"),
        "breakout": count_flag(rows, "Breakout"),
        "breakout_confirmed": count_flag(rows, "Breakout_Confirmed"),
        "distribution": count_flag(rows, "Distribution"),
    }
    for n in range(1, 5):
        counts[f"stage_{n}"] = F.count_if(rules.in_stage("Stage", n))
    if "RS_Score" in rows.columns:
        rs = number("RS_Score")
        counts["valid_rs"] = F.count(rs)
        counts["rs_leaders"] = F.count_if(rs >= c.RS_LEADER)
        counts["rs_lagging"] = F.count_if(rs < c.RS_ADEQUATE)
    out = rows.agg(*[v.alias(n) for n, v in counts.items()])
    pct_long = share_pct(F.col("above_ma_30w"), F.col("classified"))
    pct_short = share_pct(F.col("above_ma_10w"), F.col("classified"))
    out = out.withColumns({
        "pct_above_ma_30w": pct_long,
        "pct_above_ma_10w": pct_short if has_short else F.lit(None).cast("double"),
        "regime": rules.regime(pct_long),
    })
    return out.withColumn("regime_description", _regime_text(F.col("regime"))).withColumns({
        "has_ma_10w": F.lit(has_short),
        "above_ma_30w_source": F.lit("field" if "Above_MA_30W" in rows.columns else "stage"),
    })


def breadth_history(
    trends: DataFrame, sessions: int = 120, min_coverage: float = 0.5
) -> DataFrame:
    """Participation per session over each symbol's own last N trend rows.

    `trends` has columns symbol, date, close, ma_10w, ma_30w and the recency that `trend_frame`
    numbered: nothing is brought together by symbol again. A symbol's last row tells the symbols.
    """
    recent = trends.filter(F.col("recency") <= sessions)
    has = {w: F.col("close").isNotNull() & F.col(f"ma_{w}w").isNotNull() for w in (10, 30)}
    daily = recent.groupBy("date").agg(
        F.count_if(has[30]).alias("symbols"),
        F.count_if(has[30] & (F.col("close") > F.col("ma_30w"))).alias("above_ma_30w"),
        F.count_if(has[10]).alias("symbols_ma_10w"),
        F.count_if(has[10] & (F.col("close") > F.col("ma_10w"))).alias("above_ma_10w"),
    )
    universe = trends.agg(F.count_if(F.col("recency") == 1)).scalar()
    floor = F.greatest(F.lit(1), F.floor(universe * F.lit(min_coverage)))
    return daily.filter(F.col("symbols") >= floor).withColumns({
        "pct_above_ma_30w": share_pct(F.col("above_ma_30w"), F.col("symbols")),
        "pct_above_ma_10w": share_pct(F.col("above_ma_10w"), F.col("symbols_ma_10w")),
    })


def breadth_history_from_bars(bars: DataFrame, sessions: int = c.BREADTH_SESSIONS,
                              min_coverage: float = 0.5) -> DataFrame:
    trends = land(trend_frame(bars, c.PANEL_SESSIONS), "trends")
    return breadth_history(trends, sessions, min_coverage)


def with_benchmark_column(history: DataFrame, benchmark: DataFrame, ticker: str) -> DataFrame:
    """The benchmark close on the breadth calendar; a missing date stays missing."""
    index = benchmark.select("date", F.col("close").alias("benchmark_close"))
    return history.join(index, "date", "left").withColumn("benchmark_ticker", F.lit(ticker))


def industry_leadership(rows: DataFrame, industry: str = "Industry") -> DataFrame:
    """One row per industry: medians, stage 2, participation, breakouts.

    The snapshot is read once, into counts by industry, score and three-month return. RS has at most
    99 values, so its exact median keeps a table of 99 counts per group; the median return has no
    such bound and is found among the counted values.
    """
    work = rows.select(
        F.coalesce(F.col(industry).cast("string"), F.lit("Unclassified")).alias("_industry"),
        "*", *([] if "R3M" in rows.columns else [F.lit(None).cast("double").alias("R3M")]))
    out = {
        "Stocks": F.col("Symbol").isNotNull(),
        "Stage2": flag(rules.in_stage("Stage", 2)),
        "Participation": flag(above_long_line(rows)),
        "_classified": flag(classified()),
    }
    for source, name in (("Breakout_Confirmed", "Confirmed"), ("Near_52W_High", "Near_High")):
        if source in rows.columns:
            out[name] = flag(F.col(source))
    counts = value_counts(work, ["_industry", "RS_Score"], "R3M", **{
        name: test.cast("long") for name, test in out.items()})
    grouped = counts.groupBy("_industry").agg(
        F.percentile("RS_Score", 0.5, F.col("n")).alias("Median_RS"),
        *[F.sum(name).alias(name) for name in out])
    by_return = value_counts(counts, ["_industry"], "R3M", of=F.col("n")).drop("n").withColumnRenamed(
        "of", "n")
    grouped = grouped.join(
        medians(by_return, ["_industry"], "R3M", "Median_R3M"), "_industry", "left")
    return (
        grouped.withColumn(
            "Participation_Pct", share_pct(F.col("Participation"), F.col("_classified")))
        .withColumnRenamed("_industry", "Industry").drop("_classified")
        .orderBy(F.desc_nulls_last("Median_RS"), F.desc("Stocks"), F.asc("Industry"))
    )


def industry_actions(rows: DataFrame) -> DataFrame:
    """Industry board with mean and median RS, leaders and action counts; NULL keeps its group."""
    return rows.groupBy("Industry").agg(
        F.count("Symbol").alias("Stocks"),
        F.avg("RS_Score").alias("Avg_RS"),
        F.median("RS_Score").alias("Median_RS"),
        F.count_if(F.col("RS_Score") >= c.RS_LEADER).alias("Leadership"),
        F.count_if(rules.in_stage("Stage", 2)).alias("Stage2"),
        F.count_if(flag(F.col("Breakout_Confirmed"))).alias("Confirmed"),
        F.count_if(F.col("Action").isin("BUY★", "BUY")).alias("Buy"),
        F.count_if(F.col("Action") == "REDUCE").alias("Reduce"),
        F.count_if(F.col("Action") == "SELL").alias("Sell"),
    )


def _distribution(rows: DataFrame, value: Column, domain: tuple[str, ...], name: str) -> DataFrame:
    """Counts over a fixed domain, zeros included: one aggregate row turned on its side."""
    counts = rows.agg(
        F.array(*[
            F.struct(
                F.lit(i).alias("position"), F.lit(label).alias(name),
                F.count_if(flag(value == label)).alias("Stocks"),
            )
            for i, label in enumerate(domain)
        ]).alias("rows")
    )
    return counts.select(F.inline("rows"))


def action_distribution(rows: DataFrame) -> DataFrame:
    shown = _distribution(rows, F.col("Action"), c.ACTIONS, "Action")
    total = rows.agg(F.count("Action")).scalar()
    return shown.withColumn("Share_Pct", share_pct(F.col("Stocks"), total))


def stage_distribution(rows: DataFrame) -> DataFrame:
    return _distribution(rows, rules.stage_key("Stage"), c.STAGES, "Stage")


def stage2_regime(rows: DataFrame) -> DataFrame:
    """Share of the whole universe in stage 2, and the word for it."""
    share = F.avg(rules.in_stage("Stage", 2).cast("double"))
    return rows.agg(share.alias("stage2_share")).select(
        (F.col("stage2_share") * 100.0).alias("stage2_pct"),
        F.when(F.col("stage2_share") > c.STAGE2_SHARE_BROAD, "Broad participation")
        .otherwise("Selective participation").alias("regime"),
    )


def snapshot_summary(
    rows: DataFrame, universe: DataFrame, previous: DataFrame | None = None,
    breadth: DataFrame | None = None, panel: DataFrame | None = None,
    missing: dict[str, str] | None = None,
) -> DataFrame:
    """The method page's summary as one JSON document."""
    b = breadth_snapshot(rows)
    dates = rows.agg(F.max("Date").cast("string")).scalar()
    facts = b.withColumns({
        "decision_date": dates,
        "universe_rows": universe.agg(F.count(F.lit(1))).scalar(),
        "previous_session": (
            F.lit(None).cast("string") if previous is None
            else previous.agg(F.max("Date").cast("string")).scalar()
        ),
        "sessions": (
            F.lit(0) if breadth is None else breadth.agg(F.count(F.lit(1))).scalar()
        ).cast("bigint"),
    })
    unavailable = missing or {}
    document = F.to_json(F.struct(
        "decision_date",
        "previous_session",
        "universe_rows",
        F.col("symbols").alias("research_rows"),
        "valid_rs",
        F.struct(*[F.col(f"stage_{n}").alias(f"Stage {n}") for n in range(1, 5)]).alias("stages"),
        F.round("pct_above_ma_30w", 2).alias("above_30_week_pct"),
        F.col("breakout_confirmed").alias("confirmed_breakouts"),
        F.lit(panel is not None).alias("price_panel_available"),
        F.col("sessions").alias("breadth_history_sessions"),
        F.create_map(*[F.lit(t) for pair in unavailable.items() for t in pair])
        .cast("map<string,string>").alias("unavailable"),
    ), {"ignoreNullFields": "false"})
    return facts.select(document.alias("summary"))
