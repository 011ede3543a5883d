"""Cross-sectional ranks and medians that never put a whole column into one task.

A window without a partition key would sort every symbol in a single task. The
score has at most 99 levels, so the work is split differently: count equal
values, cut the value axis into balanced ranges, count within each range, and
keep only the lowest value of each score. Those few levels then turn any row's
value into its score without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breadthline import config as c
from breadthline.functions.numbers import finite
from breadthline.session import land

RANGES = 256
SKETCH_ACCURACY = 10000


def _cuts(counts: DataFrame, value: str) -> Column:
    """Balanced cut points of the distinct values, as a scalar subquery of fixed size."""
    steps = [i / RANGES for i in range(1, RANGES)]
    return counts.agg(F.percentile_approx(value, steps, SKETCH_ACCURACY)).scalar()


def score_levels(rows: DataFrame, value: str) -> DataFrame:
    """The lowest value of every score 1..99: one row with one sorted array."""
    counts = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    )
    cuts = _cuts(counts, value)
    ranged = counts.withColumn("_cuts", cuts).withColumn(
        "range", F.size(F.filter(F.col("_cuts"), lambda cut: cut < F.col(value)))
    ).drop("_cuts")
    totals = (
        ranged.groupBy("range").agg(F.sum("n").alias("n"))
        .agg(F.collect_list(F.struct("range", "n")))
    )
    in_order = Window.partitionBy("range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = ranged.withColumns({
        "below": F.coalesce(F.sum("n").over(in_order), F.lit(0)),
        "_totals": totals.scalar(),
    })
    zero = F.lit(0).cast("bigint")
    lower = F.aggregate(
        F.filter("_totals", lambda t: t["range"] < F.col("range")), zero,
        lambda total, t: total + t["n"],
    )
    everything = F.aggregate("_totals", zero, lambda total, t: total + t["n"])
    rank_pct = (F.col("below") + lower + 1) / everything
    scored = ranked.select(value, F.rint(rank_pct * 98.0 + 1.0).alias("score"))
    levels = scored.groupBy("score").agg(F.min(value).alias("from_value"))
    return levels.agg(F.sort_array(F.collect_list(F.struct("from_value", "score"))))


def rs_score(rows: DataFrame, blend: str = "RS_Blend", name: str = "RS_Score") -> DataFrame:
    """rint(percentile rank by the 'min' method x 98 + 1); a missing blend has no score."""
    levels = score_levels(rows, blend).scalar()
    reached = F.filter(F.col("_levels"), lambda level: level["from_value"] <= F.col(blend))
    return rows.withColumn("_levels", levels).withColumn(
        name, F.when(F.col(blend).isNotNull(), F.element_at(reached, -1)["score"])
    ).drop("_levels")


def value_counts(rows: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """The one pass over `rows` that counts, sums and medians of a value can be read off: a written
    table of (keys, value, n and the given sums), dealt by range of (keys, value).

    Equal values are merged before they move. A group however large lies in as many ranges as it
    fills, so no task meets it whole; `range` says in which a row lies. NULL values stay.
    """
    merged = rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(n) for n, v in sums.items()])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return land(
        merged.repartitionByRange(parts, *keys, value)
        .select("*", F.spark_partition_id().alias("range")), "value_counts")


def medians(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median of each group's finite values, from `value_counts`.

    How many values of a group lie before each of its ranges says which one or two ranges hold the
    middle; only their rows are brought into order and counted on. A group without a finite value
    has no row; NULL keys are a group.
    """
    known = counts.filter(finite(value).isNotNull())
    totals = known.groupBy(*keys, "range").agg(F.sum("n").alias("_here"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = totals.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("range").alias("_range"), "_here",
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_here").over(group).alias("_all"),
    ).withColumns({
        "_low": F.floor((F.col("_all") + 1) / 2), "_high": F.floor((F.col("_all") + 2) / 2),
    }).filter((F.col("_before") < F.col("_high")) & (F.col("_low") <= F.col("_before") + F.col("_here")))
    same = F.col("range") == F.col("_range")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    in_range = Window.partitionBy(*keys, "range").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = known.join(wanted, same).withColumn(
        "_upto", F.col("_before") + F.sum("n").over(in_range)
    ).withColumn("_from", F.col("_upto") - F.col("n") + 1)

    def at(rank: str) -> Column:
        return F.max(F.when(F.col(rank).between(F.col("_from"), F.col("_upto")), F.col(value)))

    middle = placed.groupBy(*keys).agg(at("_low").alias("_a"), at("_high").alias("_b"))
    return middle.select(*keys, ((F.col("_a") + F.col("_b")) / 2.0).alias(name))


def exact_medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group, from one pass over `rows`."""
    known = rows.filter(finite(value).isNotNull()).select(*keys, value)
    return medians(value_counts(known, keys, value), keys, value, name)


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the symbol breaks ties so that the cut is stable."""
    return rows.orderBy(*order, F.asc("Symbol")).limit(k)
