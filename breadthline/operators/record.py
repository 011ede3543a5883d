"""The forward record: cohorts, forward returns, grades, and append-only writes."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breadthline import config as c
from breadthline.functions.numbers import finite, flag, number, truthy
from breadthline.operators.corporate import is_jump
from breadthline.operators.ranking import medians, value_counts
from breadthline.session import land
from breadthline.sources.commits import Entry, Log

RECORD_SCHEMA = T.StructType([
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("horizon_weeks", T.IntegerType()),
    T.StructField("cohort", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_priced", T.LongType()),
    T.StructField("median_return_pct", T.DoubleType()),
    T.StructField("mean_return_pct", T.DoubleType()),
    T.StructField("hit_rate", T.DoubleType()),
    T.StructField("universe_median_pct", T.DoubleType()),
    T.StructField("excess_vs_universe_pp", T.DoubleType()),
    T.StructField("benchmark_return_pct", T.DoubleType()),
    T.StructField("excess_vs_benchmark_pp", T.DoubleType()),
    T.StructField("rules_version", T.StringType()),
    T.StructField("recipe_version", T.StringType()),
    T.StructField("graded_on", T.DateType()),
])


def _digest(value: object) -> str:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:12]


def recipe_version() -> str:
    """Fingerprint of the parameters that decide who lands in a cohort."""
    return _digest({
        n: v for n, v in vars(c).items()
        if n.isupper() and isinstance(v, (int, float, str, tuple, dict))
        and n not in ("COHORTS", "HORIZONS_WEEKS", "ARCHIVE_REQUIRED", "SETTLE_SESSIONS")
    })


def rules_version() -> str:
    """Fingerprint of what defines a grade: cohorts, horizons, columns, settling, recipe."""
    return _digest({
        "cohorts": c.COHORTS, "horizons": c.HORIZONS_WEEKS, "required": c.ARCHIVE_REQUIRED,
        "settle": c.SETTLE_SESSIONS, "recipe": recipe_version(),
    })


def cohort_tests() -> dict[str, Column]:
    tests = {
        "universe": F.lit(True),
        "buy_star": flag(F.trim(F.col("Action").cast("string")) == "BUY★"),
        "stage2_rs80": flag(
            F.col("Stage").cast("string").startswith("Stage 2")
            & (number("RS_Score") >= c.RS_LEADER)
        ),
        "trend_template": truthy("Trend_Template_Pass"),
        "breakout_confirmed": truthy("Breakout_Confirmed"),
    }
    assert tests.keys() == c.COHORTS.keys()
    return tests


def cohort_members(rows: DataFrame, *cohorts: str) -> DataFrame:
    """(Symbol, cohort) and the snapshot's key columns; an unknown cohort is refused."""
    unknown = set(cohorts) - set(c.COHORTS)
    if unknown:
        raise KeyError(f"unregistered cohort {sorted(unknown)}")
    wanted = {n: t for n, t in cohort_tests().items() if not cohorts or n in cohorts}
    hits = F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in wanted.items()]))
    keys = [n for n in ("snapshot_date",) if n in rows.columns]
    return rows.select(*keys, F.col("Symbol").cast("string").alias("Symbol"),
                       F.explode(hits).alias("cohort"))


# --- archive ----------------------------------------------------------------------

def frozen(rows: DataFrame, boundary: dt.date) -> DataFrame:
    """The archived form: without static columns, doubles at four decimals."""
    missing = sorted(set(c.ARCHIVE_REQUIRED) - set(rows.columns))
    if missing:
        raise ValueError(f"snapshot lacks grading column(s) {missing}")
    kept = [f for f in rows.schema.fields if f.name not in c.ARCHIVE_EXCLUDED]
    columns = [
        F.round(F.col(f"`{f.name}`"), c.ARCHIVE_DECIMALS).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in kept
    ]
    return rows.select(F.lit(boundary).alias("snapshot_date"), *columns)


def archive_snapshot(rows: DataFrame, folder: str, boundary: dt.date) -> str | None:
    """Archive the snapshot of its session; the first write wins, also of writers side by side.

    An attempt is written whole before it can count, and counts only where the log has no attempt
    for the session yet. A failed attempt leaves the session open.
    """
    log, key = Log(rows.sparkSession, folder), boundary.isoformat()

    def is_first(known: list[Entry]) -> bool:
        return all(entry.key != key for entry in known)

    if not is_first(log.entries()):
        return None
    attempt = log.begin()
    path = log.write(frozen(rows, boundary), attempt)
    if log.commit(attempt, key, allowed=is_first) is None:
        log.discard(attempt)
        return None
    return path


def archived_days(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot_date) of every archived session, from the log alone."""
    days = [(dt.date.fromisoformat(entry.key),) for entry in Log(spark, folder).entries()]
    return spark.createDataFrame(days, "snapshot_date date")


def read_archive(spark: SparkSession, folder: str, days: list[dt.date] | None = None) -> DataFrame:
    """The archived sessions (or those of `days`), one attempt of each, no other file is opened.

    Columns that the method got later are NULL in the sessions before.
    """
    log = Log(spark, folder)
    wanted = days and {day.isoformat() for day in days}
    paths = [log.path(entry.attempt) for entry in log.entries() if not wanted or entry.key in wanted]
    if not paths:
        raise FileNotFoundError(f"nothing has been archived in {folder}")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


# --- forward returns -----------------------------------------------------------------

def forward_returns(
    bars: DataFrame, horizons: tuple[int, ...] = c.HORIZONS_WEEKS,
    guard: bool = True, threshold: float = c.IMPLAUSIBLE_MOVE, due: DataFrame | None = None,
) -> DataFrame:
    """Return in percent from each session to the first session `weeks` later or after.

    With `due` (snapshot_date, horizon_weeks) only these starts and horizons are answered: bars
    before the oldest start are not read, and no other start is multiplied by the horizons.

    Rows are read newest first, where "the first session on or after d + k" is
    the last row of a running range frame. Jumps between both ends are the
    difference of two running counts in the same order. One sort per symbol
    answers every start and every horizon.
    """
    newest_first = Window.partitionBy("symbol").orderBy(F.col("back"))
    so_far = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if due is not None:
        # One session before the oldest start is enough to know its own jump.
        oldest = due.agg(F.date_sub(F.min("snapshot_date"), 10)).scalar()
        bars = bars.filter(F.col("date") >= oldest)
    closes = bars.filter(F.col("close").isNotNull()).select(
        "symbol", "date", "close", (-F.unix_date("date")).alias("back")
    )
    closes = closes.withColumn("older", F.lead("close").over(newest_first)).withColumn(
        "jump", is_jump(F.try_divide("close", "older"), threshold).cast("int")
    ).withColumn("jumps", F.sum("jump").over(so_far))
    ends = {
        f"end_{w}": F.last(F.struct("date", "close", "jump", "jumps")).over(
            newest_first.rangeBetween(Window.unboundedPreceding, -7 * w)
        )
        for w in horizons
    }
    closes = closes.withColumns(ends)
    if due is not None:
        starts = due.select(F.col("snapshot_date").alias("date")).distinct()
        closes = closes.join(starts, "date", "left_semi")
    rows = closes.select(
        "symbol", F.col("date").alias("snapshot_date"), "close", "jump", "jumps",
        F.inline(F.array(*[
            F.struct(F.lit(w).alias("horizon_weeks"), F.col(f"end_{w}").alias("end"))
            for w in horizons
        ])),
    )
    if due is not None:
        rows = rows.join(
            due.select("snapshot_date", "horizon_weeks"), ["snapshot_date", "horizon_weeks"],
            "left_semi")
    crossed = (F.col("jumps") - F.col("jump")) - (F.col("end.jumps") - F.col("end.jump")) > 0
    sound = F.col("close") > 0
    if guard:
        sound = sound & ~crossed
    return rows.select(
        "symbol", "snapshot_date", "horizon_weeks",
        F.col("end.date").alias("end_date"),
        F.when(
            sound & F.col("end").isNotNull(),
            (F.try_divide(F.col("end.close"), F.col("close")) - 1.0) * 100.0,
        ).alias("return_pct"),
    )


def gradeable_until(calendar: DataFrame) -> Column:
    """The newest day that has more than the settling sessions at or after it.

    `calendar` has one date per row; the answer is one scalar.
    """
    newest = calendar.select("date").distinct().orderBy(F.desc("date")).limit(
        c.SETTLE_SESSIONS + 1
    )
    return newest.agg(
        F.when(F.count(F.lit(1)) > c.SETTLE_SESSIONS, F.min("date"))
    ).scalar()


def with_horizons(days: DataFrame) -> DataFrame:
    weeks = F.array(*[F.lit(w) for w in c.HORIZONS_WEEKS])
    return days.withColumn("horizon_weeks", F.explode(weeks))


def pending(snapshot_days: DataFrame, record: DataFrame | None, calendar: DataFrame) -> DataFrame:
    """(snapshot_date, horizon_weeks) old enough to grade and not fully graded yet."""
    due = with_horizons(snapshot_days.select("snapshot_date").distinct())
    due = due.withColumn("_limit", gradeable_until(calendar)).filter(
        F.date_add("snapshot_date", F.col("horizon_weeks") * 7) <= F.col("_limit")
    ).drop("_limit")
    if record is None:
        return due
    done = record.groupBy("snapshot_date", "horizon_weeks").agg(
        F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= len(c.COHORTS))
    return due.join(done, ["snapshot_date", "horizon_weeks"], "left_anti")


def grade(
    snapshots: DataFrame, bars: DataFrame, benchmark: DataFrame, due: DataFrame,
    graded_on: dt.date, guard: bool = True, threshold: float = c.IMPLAUSIBLE_MOVE,
) -> DataFrame:
    """One row per due (snapshot, horizon) and cohort, for all pairs in one plan.

    `snapshots` carries snapshot_date and the columns the cohorts read.
    """
    by_pair = ["snapshot_date", "horizon_weeks"]
    due = land(due, "due")
    returns = forward_returns(bars, guard=guard, threshold=threshold, due=due)
    # The benchmark is one series: one row per session, whatever the universe.
    index = forward_returns(
        benchmark.select(F.lit("benchmark").alias("symbol"), "date", "close"),
        guard=guard, threshold=threshold, due=due,
    ).select(*by_pair, F.col("return_pct").alias("_benchmark"))
    tests = cohort_tests()
    members = snapshots.select(
        "snapshot_date", F.col("Symbol").cast("string").alias("symbol"),
        *[t.alias(f"in_{n}") for n, t in tests.items()],
    ).join(due, "snapshot_date")
    priced = members.join(
        returns.select("symbol", *by_pair, "return_pct"), ["symbol", *by_pair], "left"
    ).select(*by_pair, finite("return_pct").alias("return_pct"), F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"in_{n}"), F.lit(n)) for n in tests
    ]))).alias("cohort"))
    # Everything below is read off this table; the joins above run once.
    group = [*by_pair, "cohort"]
    counts = value_counts(priced, group, "return_pct")
    known = F.when(F.col("return_pct").isNotNull(), F.col("n"))
    stats = land(
        counts.groupBy(*group).agg(
            F.sum("n").alias("n"), F.sum(known).alias("n_priced"),
            F.sum(F.col("return_pct") * F.col("n")).alias("_sum"),
            F.sum(F.when(F.col("return_pct") > 0, F.col("n"))).alias("_hits"),
        ).join(medians(counts, group, "return_pct", "_median"), group, "left"), "cohort_stats")
    universe = stats.filter(F.col("cohort") == "universe").select(
        *by_pair, F.col("_median").alias("_universe")
    )
    # Every cohort has a row, also one without members.
    names = F.array(*[F.lit(n) for n in tests])
    nothing = F.lit(0).cast("long")
    graded = (
        universe.withColumn("cohort", F.explode(names)).join(stats, group, "left")
        .join(index, by_pair, "left")
        .withColumns({
            "n": F.coalesce("n", nothing), "n_priced": F.coalesce("n_priced", nothing),
            "_mean": F.col("_sum") / F.col("n_priced"),
            "_hit": F.when(F.col("n_priced") > 0,
                           F.coalesce("_hits", nothing) / F.col("n_priced")),
        })
    )

    def rounded(value: Column) -> Column:
        return F.round(value, c.ARCHIVE_DECIMALS)

    median = F.col("_median")
    return graded.select(
        *by_pair, "cohort", "n", "n_priced",
        rounded(median).alias("median_return_pct"),
        rounded(F.col("_mean")).alias("mean_return_pct"),
        rounded(F.col("_hit")).alias("hit_rate"),
        rounded(F.col("_universe")).alias("universe_median_pct"),
        rounded(median - F.col("_universe")).alias("excess_vs_universe_pp"),
        rounded(F.col("_benchmark")).alias("benchmark_return_pct"),
        rounded(median - F.col("_benchmark")).alias("excess_vs_benchmark_pp"),
        F.lit(rules_version()).alias("rules_version"),
        F.lit(recipe_version()).alias("recipe_version"),
        F.lit(graded_on).alias("graded_on"),
    )


def append_only(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Existing rows as they are, plus new rows whose key is absent."""
    if existing is None:
        return new
    fresh = new.join(existing.select(*c.RECORD_KEY), list(c.RECORD_KEY), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def empty_record(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)


def ensure_record(spark: SparkSession, path: str) -> bool:
    """Write an empty record where there is none; never touches an existing one."""
    log = Log(spark, path)
    if log.entries():
        return False
    attempt = log.begin()
    log.write(empty_record(spark), attempt)
    if log.commit(attempt, "empty", allowed=lambda known: not known) is None:
        log.discard(attempt)
        return False
    return True


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the record; an empty one where there is none."""
    paths = Log(spark, path).paths()
    if not paths:
        return empty_record(spark)
    return spark.read.schema(RECORD_SCHEMA).parquet(*paths)


def append_grades(spark: SparkSession, path: str, new: DataFrame) -> int:
    """Append the rows the record lacks; their number. Earlier files are not rewritten.

    What is missing is decided against the log as it is; where another writer commits first, it is
    decided again, so that a key is never in the record twice.
    """
    ensure_record(spark, path)
    new = land(new.select(*RECORD_SCHEMA.fieldNames()), "grades")
    log = Log(spark, path)
    while True:
        seen = log.entries()
        existing = read_record(spark, path)
        fresh = new.join(existing.select(*c.RECORD_KEY), list(c.RECORD_KEY), "left_anti")
        attempt = log.begin()
        written = spark.read.schema(RECORD_SCHEMA).parquet(log.write(fresh, attempt)).count()
        if written and log.commit(attempt, "grades", allowed=lambda known: known == seen):
            return written
        log.discard(attempt)
        if not written:
            return 0
