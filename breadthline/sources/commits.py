"""A log of written attempts in a shared folder: what is in it was written whole, and once.

Data goes to a folder of its own first. One small file with the next number then says that it
counts; the file appears under its name at once and complete, and never where there is one already.
A writer that finds its number taken reads the log again and decides anew. Readers look at the log
only, so half-written attempts and those of lost writers are never seen.

The put relies on a rename that refuses an existing target (HDFS and most cluster file systems) or
on a hard link (local folders). On an object store without either, let one writer work at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "number long, attempt string, key string, tables array<string>"


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and the file system that owns it."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    location, system = file_system(spark, path)
    return system.exists(location)


def remove(spark: SparkSession, path: str) -> None:
    location, system = file_system(spark, path)
    system.delete(location, True)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file where there is none; False if there is one, whoever wrote it."""
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    location, system = file_system(spark, draft)
    system.mkdirs(location.getParent())
    stream = system.create(location, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getScheme() == "file":
            return _link(draft, path)
        return _rename(spark, draft, path)
    finally:
        system.delete(location, False)


def _link(draft: str, path: str) -> bool:
    def local(name: str) -> str:
        return unquote(urlparse(name).path) if name.startswith("file:") else name

    try:
        os.link(local(draft), local(path))
    except FileExistsError:
        return False
    return True


def _rename(spark: SparkSession, draft: str, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, _ = file_system(spark, draft)
    target, system = file_system(spark, path)
    context = hadoop.FileContext.getFileContext(
        system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(source, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


@dataclass(frozen=True)
class Entry:
    """number: place in the log. attempt: folder of the data. key: what it is about. tables: in it."""
    number: int
    attempt: str
    key: str
    tables: tuple[str, ...] = ()


class Log:
    """The log of one folder; data of attempt x lies in `<folder>/attempts/x`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> list[Entry]:
        """In order. One row for each commit."""
        if not exists(self.spark, f"{self.folder}/log"):
            return []
        rows = self.spark.read.schema(ENTRY).json(f"{self.folder}/log").orderBy("number").collect()
        return [Entry(r["number"], r["attempt"], r["key"], tuple(r["tables"] or ())) for r in rows]

    def latest(self) -> Entry | None:
        return (self.entries() or [None])[-1]

    def path(self, attempt: str, table: str = "") -> str:
        return f"{self.folder}/attempts/{attempt}" + (f"/{table}" if table else "")

    def paths(self) -> list[str]:
        """Data that counts, of commits about a single table."""
        return [self.path(e.attempt) for e in self.entries()]

    def begin(self) -> str:
        return uuid.uuid4().hex

    def commit(self, attempt: str, key: str, tables: tuple[str, ...] = (),
               allowed: Callable[[list[Entry]], bool] = lambda known: True) -> Entry | None:
        """Makes the attempt count, unless the log by then does not allow it."""
        while True:
            known = self.entries()
            if not allowed(known):
                return None
            entry = Entry(known[-1].number + 1 if known else 1, attempt, key, tables)
            text = json.dumps({"number": entry.number, "attempt": attempt, "key": key,
                               "tables": list(tables)})
            if put_if_absent(self.spark, f"{self.folder}/log/{entry.number:010d}.json", text):
                return entry

    def write(self, rows: DataFrame, attempt: str, table: str = "") -> str:
        path = self.path(attempt, table)
        rows.write.parquet(path)
        return path

    def discard(self, attempt: str) -> None:
        """Removes an attempt of one's own that did not come to count."""
        remove(self.spark, self.path(attempt))

    def expire(self, keep: int) -> int:
        """Removes the data of all but the last `keep` commits; the log itself stays whole.

        For logs whose newest commit replaces the others. Readers that follow an older commit need
        it until they are done, so keep a few.
        """
        old = self.entries()[:-keep] if keep else self.entries()
        gone = [e for e in old if exists(self.spark, self.path(e.attempt))]
        for entry in gone:
            self.discard(entry.attempt)
        return len(gone)
