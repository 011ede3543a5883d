"""Whole jobs end to end, and the shape of the plans they run."""

from __future__ import annotations

import datetime as dt
import threading
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breadthline.operators import boundary, corporate, indicators, record, reconcile
from breadthline.operators.corporate import MassEventError
from breadthline.plans import audit, grading, research
from breadthline.session import land, land_by_symbol, shared_folder
from breadthline.sources import readers, sinks
from breadthline.sources.commits import Log, exists, put_if_absent
from tests.helpers import bars_of, day, walk

DECISION = day("2026-08-22")


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    frames = [walk(f"S{i:02}", i, blanks=0.01 if i % 3 else 0.0) for i in range(24)]
    frames.append(walk("YOUNG", 50, sessions=90))
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    bars_of(spark, pd.concat(frames)).write.parquet(path)
    bars = readers.read_bars(spark, path)
    names = bars.select(F.col("symbol").alias("Symbol")).distinct().select(
        "Symbol", F.concat(F.lit("Co "), "Symbol").alias("Company Name"),
        F.substring("Symbol", 1, 2).alias("Industry"), F.lit("EQ").alias("Series"))
    rng = np.random.default_rng(9)
    dates = pd.bdate_range(end="2026-08-21", periods=620)
    index = spark.createDataFrame(
        [(d.date(), float(v)) for d, v in zip(dates, 20000 + np.cumsum(rng.normal(2, 60, 620)))],
        "date date, close double")
    return bars, names, index


def test_audit_publishes_then_refuses_to_go_back(spark, market, tmp_path):
    bars, names, index = market
    folder = str(tmp_path / "out")
    done = audit.run_audit(spark, bars, names, DECISION, folder, index, "INDEX")
    assert done.published and done.boundary == day("2026-08-21")
    assert done.previous_boundary == day("2026-08-20") or done.previous_boundary < done.boundary
    snapshot = readers.load_snapshot(spark, folder, names)
    assert snapshot.missing == {} and snapshot.has("RS_Score", "Trend_Health")
    assert snapshot.research.count() == 25 and snapshot.previous.count() > 0
    assert snapshot.breadth.filter("benchmark_ticker = 'INDEX'").count() > 100
    maturing = spark.read.parquet(sinks.published(spark, folder)["maturing"]).collect()
    assert [r["Symbol"] for r in maturing] == ["YOUNG"]
    assert record.read_archive(spark, f"{folder}/snapshots").count() == 25

    again = audit.run_audit(spark, bars, names, DECISION, folder, index, "INDEX")
    assert again.published and again.archived is None
    back = audit.run_audit(spark, bars, names, day("2026-08-10"), folder, index)
    assert not back.published


def test_audit_leaves_out_malformed_symbols_and_outsiders(spark, market, tmp_path):
    """A doubled history is excluded by name; outsiders do not move the boundary."""
    bars, names, index = market
    doubled = bars.filter("symbol = 'S03'")
    stale = [f"S{i:02}" for i in range(4, 7)]
    some = bars.filter(~(F.col("symbol").isin(stale) & (F.col("date") == day("2026-08-21"))))
    outsiders = bars.filter("symbol = 'S01'").crossJoin(spark.range(30)).withColumn(
        "symbol", F.concat(F.lit("X"), F.col("id").cast("string"))).drop("id")
    folder = str(tmp_path / "out")
    done = audit.run_audit(
        spark, some.unionByName(doubled).unionByName(outsiders), names, DECISION, folder, index,
        "INDEX", max_loss_pct=10)
    assert done.published and done.boundary == day("2026-08-20")
    tables = sinks.published(spark, folder)
    excluded = {r["symbol"]: r["reason"]
                for r in spark.read.parquet(tables["excluded"]).collect()}
    assert excluded == {"S03": boundary.DUPLICATES}
    current = spark.read.parquet(tables["research"])
    assert current.count() == 24
    previous = spark.read.parquet(tables["previous"])
    assert previous.join(current, "Symbol", "left_anti").isEmpty()


def test_previous_snapshot_ranks_the_symbols_of_the_current_one(spark, market):
    bars, names, index = market
    kept = names.filter("Symbol <> 'S02'")
    day_, previous = audit.previous_snapshot(bars, names, kept, day("2026-08-21"), 90.0, index, 200)
    want = research.research(bars, kept, day_, index, 200)
    columns = ["Symbol", "RS_Score", "Action"]
    assert sorted(previous.select(*columns).collect()) == sorted(want.select(*columns).collect())
    assert previous.filter("Symbol = 'S02'").isEmpty()


def test_unreadable_tables_are_not_unpublished(spark, market, tmp_path):
    bars, names, index = market
    folder = tmp_path / "out"
    audit.run_audit(spark, bars, names, DECISION, str(folder), index, "INDEX")
    for part in Path(sinks.published(spark, str(folder))["previous"]).glob("*.parquet"):
        part.write_bytes(b"broken")
    with pytest.raises(Exception, match="(?i)parquet|footer|schema"):
        readers.load_snapshot(spark, str(folder), names).previous.count()


def test_due_returns_are_the_same_rows(spark, market):
    bars, _, _ = market
    days = [day("2026-02-02"), day("2026-03-02")]
    due = spark.createDataFrame([(days[0], 4), (days[1], 4), (days[1], 13)],
                                "snapshot_date date, horizon_weeks int")
    keys = ["symbol", "snapshot_date", "horizon_weeks", "end_date", "return_pct"]
    some = record.forward_returns(bars, due=due).select(*keys)
    every = record.forward_returns(bars).join(due, ["snapshot_date", "horizon_weeks"], "left_semi")
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*keys).collect()))


def test_audit_stops_before_writing(spark, market, tmp_path):
    bars, names, index = market
    folder = str(tmp_path / "out")
    halved = bars.withColumn("close", F.when(
        F.col("date") == F.lit(day("2026-08-21")), F.col("close") / 2).otherwise(F.col("close")))
    with pytest.raises(MassEventError):
        audit.run_audit(spark, halved, names, DECISION, folder, index)
    stale = bars.filter("NOT (date > DATE '2025-08-01' AND symbol IN ('S01', 'S02'))")
    with pytest.raises(boundary.CoverageError):
        audit.run_audit(spark, stale, names, DECISION, folder, index)
    assert sinks.published(spark, folder) is None


def test_both_computations_agree_and_a_wrong_one_is_found(spark, market):
    bars, _, _ = market
    rows = research.measured_rows(bars, day("2026-08-21"))
    second = reconcile.independent_fields(bars, day("2026-08-21"))
    assert reconcile.mismatches(reconcile.compare(rows, second)).count() == 0
    wrong = rows.withColumn("SMA_200", F.col("SMA_200") + 1e-6)
    bad = reconcile.mismatches(reconcile.compare(wrong, second))
    assert {r["field"] for r in bad.collect()} == {"SMA_200"}
    other = rows.withColumn("Stage", F.when(F.col("Symbol") != "S03", F.col("Stage")))
    off = reconcile.mismatches(reconcile.compare(other, second)).collect()
    assert {(r["field"], r["Symbol"], r["actual"], r["gap"]) for r in off} == {
        ("Stage", "S03", None, None)}
    report = reconcile.field_report(reconcile.compare(wrong, second))
    worst = reconcile.loosest(report).first()
    assert worst["field"] == "SMA_200" and worst["largest_gap"] > 1e-10
    good = reconcile.loosest(reconcile.field_report(reconcile.compare(rows, second))).first()
    assert good["largest_gap"] <= reconcile.TIGHT
    absent = reconcile.mismatches(reconcile.compare(rows.drop("U_D"), second))
    assert {r["field"] for r in absent.collect()} == {"U_D"}


def test_grading_appends_once(spark, market, tmp_path):
    bars, names, index = market
    archive, path = str(tmp_path / "snapshots"), str(tmp_path / "record")
    for text in ("2026-05-04", "2026-06-01"):
        cut = day(text)
        rows = research.research(bars, names, cut, index)
        record.archive_snapshot(rows, archive, cut)
    first = grading.run_grading(spark, archive, path, bars, index, day("2026-08-22"))
    pairs = {(str(r["snapshot_date"]), r["horizon_weeks"]) for r in first.collect()}
    assert pairs == {("2026-05-04", 4), ("2026-05-04", 8), ("2026-05-04", 13),
                     ("2026-06-01", 4), ("2026-06-01", 8)}
    stored = record.read_record(spark, path)
    assert stored.count() == 25 and stored.filter("n_priced > n").count() == 0
    second = grading.run_grading(spark, archive, path, bars, index, day("2026-08-23"))
    assert second.count() == 0 and record.read_record(spark, path).count() == 25


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_shuffles_once_and_sorts_once(spark, market):
    bars, _, index = market
    plan = plan_of(research.measured_rows(bars, day("2026-08-21"), index))
    assert plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.count("Sort [symbol") == 1
    assert "Exchange SinglePartition" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "LessThanOrEqual(date,2026-08-21)" in plan


def test_bucketed_bars_are_not_shuffled_again(spark, market):
    bars, _, index = market
    landed, index = land_by_symbol(bars, "bars"), land(index, "index")
    assert landed.count() == bars.count()
    for job in (
        research.measured_rows(landed, day("2026-08-21"), index),
        indicators.trend_frame(landed),
        record.forward_returns(landed),
        corporate.scan(landed),
        reconcile.independent_fields(landed, day("2026-08-21")),
    ):
        assert "Exchange hashpartitioning(symbol" not in plan_of(job)


def test_breadth_history_brings_symbols_together_once(spark, market):
    from breadthline.operators import aggregates

    bars, _, _ = market
    plan = plan_of(aggregates.breadth_history(indicators.trend_frame(bars)))
    # The scalar with the number of symbols is a second reading of the same trend rows.
    assert plan.count("Exchange hashpartitioning(symbol") <= 2
    trends = land(indicators.trend_frame(bars), "trends")
    assert "Exchange hashpartitioning(symbol" not in plan_of(aggregates.breadth_history(trends))


def test_score_never_sorts_all_symbols_in_one_task(spark):
    from breadthline.operators.ranking import rs_score

    rows = spark.range(1000).selectExpr("string(id) AS Symbol", "rand(7) AS RS_Blend")
    plan = plan_of(rs_score(rows))
    for line in plan.splitlines():
        if "Window" in line and "specifiedwindowframe" in line:
            assert "windowspecdefinition(range#" in line
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_intermediate_tables_live_in_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark).startswith((folder or shared_folder(spark)).rstrip("/"))


# --- publication, archive and record side by side -----------------------------------------------

def set_of(spark, folder, day_, word, names=("research", "breadth")):
    run = sinks.Publication(spark, folder)
    for name in names:
        run.write(spark.createDataFrame([(word, day_)], "word string, day date"), name)
    return run


def words(spark, folder):
    return {name: [r["word"] for r in spark.read.parquet(path).collect()]
            for name, path in sinks.published(spark, folder).items()}


def test_a_run_stopped_between_two_tables_leaves_the_old_set(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert sinks.published(spark, folder) is None and sinks.published_session(spark, folder) is None
    assert set_of(spark, folder, day("2026-08-20"), "old").commit(day("2026-08-20"))
    stopped = set_of(spark, folder, day("2026-08-21"), "half", names=("research",))
    assert words(spark, folder) == {"research": ["old"], "breadth": ["old"]}
    broken = spark.range(8).select(
        F.when(F.col("id") < 7, "x").otherwise(F.raise_error(F.lit("lost"))).alias("word"))
    with pytest.raises(Exception, match="lost"):
        stopped.write(broken, "breadth")
    assert words(spark, folder) == {"research": ["old"], "breadth": ["old"]}
    # A reader that has begun keeps its set while another one is published.
    before = spark.read.parquet(sinks.published(spark, folder)["breadth"])
    assert set_of(spark, folder, day("2026-08-21"), "new").commit(day("2026-08-21"))
    assert [r["word"] for r in before.collect()] == ["old"]
    assert words(spark, folder) == {"research": ["new"], "breadth": ["new"]}


def test_publishing_never_goes_back_and_old_sets_expire(spark, tmp_path):
    folder = str(tmp_path / "out")
    late = set_of(spark, folder, day("2026-08-20"), "early")
    assert set_of(spark, folder, day("2026-08-21"), "first").commit(day("2026-08-21"))
    assert not late.commit(day("2026-08-20")) and not exists(spark, late.path("research"))
    assert set_of(spark, folder, day("2026-08-21"), "again").commit(day("2026-08-21"))
    assert words(spark, folder)["research"] == ["again"]
    assert Log(spark, folder).expire(keep=1) == 1 and Log(spark, folder).expire(keep=1) == 0
    assert words(spark, folder)["research"] == ["again"]


def side_by_side(*jobs):
    """Runs the jobs in threads of their own; their results."""
    results = [None] * len(jobs)

    def run(at, job):
        results[at] = job()

    threads = [threading.Thread(target=run, args=(i, job)) for i, job in enumerate(jobs)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return results


def test_one_file_is_put_once(spark, tmp_path):
    for name in (str(tmp_path / "a" / "x"), f"file://{tmp_path}/b/x"):
        done = side_by_side(*[lambda i=i: put_if_absent(spark, name, f"{i}") for i in range(8)])
        assert done.count(True) == 1
        path = Path(name.removeprefix("file://"))
        assert path.read_text() == str(done.index(True))
        # No draft is left for readers of the folder.
        assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["x"]


def test_a_rename_refuses_an_existing_file_too(spark, tmp_path):
    from breadthline.sources import commits

    for name in ("one", "two"):
        (tmp_path / name).write_text(name)
    assert commits._rename(spark, f"file://{tmp_path}/one", f"file://{tmp_path}/three")
    assert not commits._rename(spark, f"file://{tmp_path}/two", f"file://{tmp_path}/three")
    assert (tmp_path / "three").read_text() == "one" and (tmp_path / "two").exists()


def test_two_archives_of_one_session_keep_one(spark, market, tmp_path):
    bars, names, index = market
    rows = land(research.research(bars, names, day("2026-08-21"), index, 200), "rows")
    folder = str(tmp_path / "archive")
    gate = threading.Barrier(3)
    plain = Log.write

    def write(self, *args):
        path = plain(self, *args)
        gate.wait(timeout=120)  # all three have written before one of them commits
        return path

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Log, "write", write)
        done = side_by_side(*[
            lambda n=n: record.archive_snapshot(rows.withColumn("Close", F.lit(float(n))), folder,
                                                day("2026-08-21")) for n in range(3)])
    assert [d is not None for d in done].count(True) == 1
    winner = [d is not None for d in done].index(True)
    kept = record.read_archive(spark, folder)
    assert kept.count() == rows.count()
    assert [r[0] for r in kept.select("Close").distinct().collect()] == [float(winner)]
    assert len(list((tmp_path / "archive" / "attempts").iterdir())) == 1
    assert record.archive_snapshot(rows, folder, day("2026-08-21")) is None
    assert record.archive_snapshot(rows, folder, day("2026-08-24")) is not None
    days = [r[0] for r in record.archived_days(spark, folder).orderBy("snapshot_date").collect()]
    assert days == [dt.date(2026, 8, 21), dt.date(2026, 8, 24)]
    only = record.read_archive(spark, folder, [dt.date(2026, 8, 24)])
    assert [r[0] for r in only.select("snapshot_date").distinct().collect()] == days[1:]


def test_two_writers_never_grade_a_key_twice(spark, tmp_path):
    path = str(tmp_path / "record")
    names = record.RECORD_SCHEMA.fieldNames()

    def grades(*cohorts, n):
        rows = [tuple({"snapshot_date": day("2026-05-04"), "horizon_weeks": 4, "cohort": x,
                       "n": n}.get(f) for f in names) for x in cohorts]
        return spark.createDataFrame(rows, record.RECORD_SCHEMA)

    added = side_by_side(
        lambda: record.append_grades(spark, path, grades("universe", "buy_star", n=1)),
        lambda: record.append_grades(spark, path, grades("universe", "trend_template", n=2)))
    found = record.read_record(spark, path)
    assert sorted(added) == [1, 2] and found.count() == 3
    assert found.select("cohort").distinct().count() == 3
    assert record.append_grades(spark, path, grades("universe", "buy_star", n=3)) == 0
