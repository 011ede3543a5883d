"""Published outputs of one run: all of its tables at once, or none of them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from breadthline.sources.commits import Log


class Publication:
    """The tables of one run, in a folder of their own until `commit` makes them the published set.

    A run that stops before leaves the old set as it is. Two runs may publish side by side: the
    later commit is the published set, and none goes back to an earlier session.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.log = Log(spark, folder)
        self.attempt = self.log.begin()
        self.tables: list[str] = []

    def write(self, rows: DataFrame, name: str) -> str:
        self.tables.append(name)
        return self.log.write(rows, self.attempt, name)

    def path(self, name: str) -> str:
        """Where a writer of its own puts a table of this run."""
        self.tables.append(name)
        return self.log.path(self.attempt, name)

    def commit(self, session: dt.date) -> bool:
        """Publishes the set; False, and nothing changes, where a later session is published."""
        key = session.isoformat()
        entry = self.log.commit(self.attempt, key, tuple(self.tables),
                                lambda known: not known or known[-1].key <= key)
        if entry is None:
            self.log.discard(self.attempt)
        return entry is not None


def published(spark: SparkSession, folder: str) -> dict[str, str] | None:
    """Path of each table of the published set; None where nothing has been published."""
    log = Log(spark, folder)
    latest = log.latest()
    return latest and {name: log.path(latest.attempt, name) for name in latest.tables}


def published_session(spark: SparkSession, folder: str) -> dt.date | None:
    latest = Log(spark, folder).latest()
    return latest and dt.date.fromisoformat(latest.key)


def download_csv(rows: DataFrame, path: str) -> str:
    """All filtered rows as CSV with a header, in as many files as there are tasks."""
    rows.write.mode("overwrite").csv(path, header=True)
    return path
