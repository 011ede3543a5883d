"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default all)
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import uuid

from breadthline.plans.audit import run_audit
from breadthline.plans.grading import run_grading
from breadthline.session import local_session, shared_folder
from verification import QUERIES
from verification.inputs import DECISION, Inputs

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINES = (
    "bars", "session_coverage", "rs_score", "moving_averages", "breadth_history",
    "research", "research_supplier", "independent_fields", "corporate_actions",
    "spans_discontinuity", "forward_returns", "grade_snapshot", "transitions", "rs_movers",
    "industry_leadership", "breadth_snapshot", "signal_rows", "screen_presets",
    "liquidity_admission", "exact_median_price", "swing_points", "vcp_footprints",
)


def jobs(spark) -> dict[str, float]:
    """The daily job from trade lines to the published set, and the grading of what it archived.

    Thresholds and guards are those of production, but for one symbol in 33 that has no close.
    """
    given = Inputs(spark, FOLDER, "shaped")
    folder = f"{shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    started = time.perf_counter()
    done = run_audit(spark, given.bars(), given.universe(), dt.date(1997, 1, 15), folder,
                     given.benchmark(), "INDEX", max_loss_pct=5.0)
    audited = time.perf_counter()
    assert done.published and done.archived, done.notes
    grades = run_grading(spark, f"{folder}/snapshots", f"{folder}/record", given.bars(),
                         given.benchmark(), DECISION)
    assert grades.count() > 0
    return {"run_audit": audited - started, "run_grading": time.perf_counter() - audited}


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    seconds |= {name: round(spent, 3) for name, spent in jobs(spark).items()}
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
