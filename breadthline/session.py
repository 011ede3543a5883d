"""Session settings and the one place that writes intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "breadthline") -> SparkSession:
    """A session for tests and the local benchmark. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir.

    A local master without the setting gets a temporary folder that goes away
    with the process. A cluster without it is refused, because a folder on one
    machine is gone with that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="breadthline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def land(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several jobs read one costly intermediate (bars from raw trades,
    one row per symbol before the ranking). The written table survives the loss
    of executors, keeps column pruning and filter pushdown, and gives the
    optimizer true sizes, so that it broadcasts by measurement.
    """
    path = f"{shared_folder(df.sparkSession)}/breadthline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_by_symbol(df: DataFrame, name: str) -> DataFrame:
    """Like `land`, bucketed by symbol.

    Every window over the history is partitioned by symbol. Reading buckets
    satisfies that partitioning, so the shuffle paid here is the last one: the
    snapshot, the previous snapshot, the trends, the second computation and the
    jump scan all read the table without moving rows between executors.
    """
    spark = df.sparkSession
    table = f"breadthline_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The benchmark is joined by broadcast between the scan and the windows; Spark
    # would take that join as a reason to read the table without its buckets.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    (
        df.repartition(buckets, "symbol").write.bucketBy(buckets, "symbol")
        .sortBy("symbol", "date").option("path", f"{shared_folder(spark)}/breadthline/{table}")
        .format("parquet").saveAsTable(table)
    )
    return spark.table(table)
