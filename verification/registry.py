"""One entry per query: its columns, its Spark form and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from verification.inputs import Inputs
from verification.present import tidy, tidy_sql


@dataclass(frozen=True)
class Query:
    columns: str
    build: Callable[[Inputs], DataFrame]
    variant: str = "nation"
    ctes: str | None = None
    source: str = "result"

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return tidy(self.build(Inputs(spark, folder, self.variant)), self.columns)

    def sql(self) -> str | None:
        if self.ctes is None:
            return None
        return f"{self.ctes} {tidy_sql(self.columns, self.source)}"


QUERIES: dict[str, Query] = {}


def register(name: str, columns: str, variant: str = "nation", ctes: str | None = None,
             source: str = "result"):
    """Decorator: adds the decorated builder under its name."""
    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = Query(columns, build, variant, ctes, source)
        return build

    return add
