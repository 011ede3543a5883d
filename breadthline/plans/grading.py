"""The monthly job: grade every due snapshot and horizon in one plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from breadthline import config as c
from breadthline.operators import record
from breadthline.session import land


def run_grading(
    spark: SparkSession, archive: str, record_path: str, bars: DataFrame, benchmark: DataFrame,
    graded_on: dt.date, guard: bool = True, threshold: float = c.IMPLAUSIBLE_MOVE,
    dry_run: bool = False,
) -> DataFrame:
    """The new grades; appended to the record unless this is a dry run."""
    if not dry_run:
        record.ensure_record(spark, record_path)
    existing = None if dry_run else record.read_record(spark, record_path)
    days = record.archived_days(spark, archive)
    due = land(
        record.pending(days, existing, benchmark.filter("close IS NOT NULL")), "due"
    )
    # A few days, whatever the universe; only their files are opened.
    wanted = [row[0] for row in due.select("snapshot_date").distinct().collect()]
    snapshots = record.read_archive(spark, archive, wanted)
    grades = land(
        record.grade(snapshots, bars, benchmark, due, graded_on, guard, threshold), "grades"
    )
    if not dry_run:
        record.append_grades(spark, record_path, grades)
    return grades
