"""What changed between two snapshots: one join by symbol, then groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions import rules
from breadthline.functions.numbers import flag, number

SHOWN = ("RS_Score", "Stage", "Industry", "Company Name", "Ext_Pct", "Close", "Action")


def aligned(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Symbols in both snapshots; previous columns carry the prefix `was_`."""
    before = previous.select(*[
        F.col(f"`{n}`").alias("Symbol" if n == "Symbol" else f"was_{n}") for n in previous.columns
    ])
    return current.join(before, "Symbol")


def _shown(rows: DataFrame) -> list:
    return ["Symbol", *[F.col(f"`{n}`") for n in SHOWN if n in rows.columns]]


def stage_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    both = aligned(current, previous).withColumns({
        "Stage_To": rules.stage_key("Stage"),
        "Stage_From": rules.stage_key("was_Stage"),
    })
    return both.filter(F.col("Stage_From") != F.col("Stage_To")).select(
        *_shown(current), "Stage_From", "Stage_To"
    )


def transitions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per symbol and group it moved into.

    A field missing on either side yields no group: its arrival is not a move.
    """
    both = aligned(current, previous)
    shared = set(current.columns) & set(previous.columns)
    groups = []

    def group(moved, label: str, text: str, old, new) -> None:
        groups.append(F.when(flag(moved), F.struct(
            F.lit(label).alias("group"), F.lit(text).alias("description"),
            old.cast("string").alias("value_from"), new.cast("string").alias("value_to"),
        )))

    if "Stage" in shared:
        now, was = rules.stage_key("Stage"), rules.stage_key("was_Stage")
        for label, moved in (
            ("Entered Stage 2 — Advancing", now == "Stage 2"),
            ("Left Stage 2 — Advancing", was == "Stage 2"),
            ("Entered Stage 4 — Declining", now == "Stage 4"),
        ):
            group((now != was) & moved, label, c.STAGE_GROUP_TEXT, was, now)
    for field, to_true, label, text in c.FLAG_MOVES:
        if field not in shared:
            continue
        now, was = flag(F.col(field)), flag(F.col(f"was_{field}"))
        group((now & ~was) if to_true else (~now & was), label, text, was, now)
    if "Action" in shared:
        group(F.col("Action") != F.col("was_Action"), "Action changed", c.ACTION_GROUP_TEXT,
              F.col("was_Action"), F.col("Action"))
    moved = F.filter(F.array(*groups), lambda g: g.isNotNull())
    return both.select(*_shown(current), F.inline(moved))


def transition_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    return transitions(current, previous).groupBy("group").agg(
        F.count(F.lit(1)).alias("symbols")
    )


def shown_first(moves: DataFrame, inline: int = c.MOVERS_INLINE) -> DataFrame:
    """Adds `Inline`: whether a move is among the first of its group, by symbol, or with the rest.

    Only the first rows of a group are ranked, each task keeping no more than that many of its own;
    where they end is one symbol for each of the fixed groups, and every row compares itself with it.
    """
    place = F.row_number().over(Window.partitionBy("group").orderBy("Symbol"))
    ends = moves.select("group", "Symbol", place.alias("place")).filter(
        F.col("place") <= inline).groupBy("group").agg(F.max("Symbol").alias("_last"))
    return moves.join(ends, "group").withColumn("Inline", F.col("Symbol") <= F.col("_last")).drop("_last")


def rs_movers(current: DataFrame, previous: DataFrame, count: int = 15) -> DataFrame:
    """The largest changes of relative-strength rank, biggest rise first."""
    both = aligned(current, previous).withColumn("RS_Previous", number("was_RS_Score"))
    both = both.withColumn("RS_Change", number("RS_Score") - F.col("RS_Previous"))
    largest = both.filter(F.col("RS_Change").isNotNull()).orderBy(
        F.desc(F.abs("RS_Change")), F.asc("Symbol")
    ).limit(count)
    return largest.select(*_shown(current), "RS_Change", "RS_Previous").orderBy(
        F.desc("RS_Change"), F.asc("Symbol")
    )
