"""Bars, benchmark and universe out of the given tables, in four variants.

    nation    one symbol per nation, industry = region
    settled   the same, but only settled lines (status F) set the close, so that
              sessions without a close occur inside a history
    supplier  one symbol per supplier, industry = nation
    shaped    one symbol per shape of `shaped.SHAPES`, so that every rule has its case
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breadthline.operators import boundary
from breadthline.session import land, land_by_symbol
from breadthline.sources import trades
from verification import shaped

DECISION = dt.date(1999, 1, 4)


@dataclass(frozen=True)
class Variant:
    name: str
    min_pct: float
    min_sessions: int
    settled: bool = False


VARIANTS = {
    "nation": Variant("nation", 50.0, 200),
    "settled": Variant("settled", 25.0, 200, settled=True),
    "supplier": Variant("supplier", 15.0, 20),
    "shaped": Variant("shaped", 60.0, 200),
}


class Inputs:
    def __init__(self, spark: SparkSession, folder: str, variant: str = "nation") -> None:
        self.spark = spark
        self.folder = folder
        self.variant = VARIANTS[variant]
        self._bars: DataFrame | None = None
        self._benchmark: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def suppliers(self) -> DataFrame:
        """Supplier with its nation and region; the two dimensions have 25 and 5 rows."""
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "s_name", "s_acctbal", "n_name", "r_name")
        )

    def _symbol(self) -> str:
        return "s_name" if self.variant.name == "supplier" else "n_name"

    def lines(self) -> DataFrame:
        return self.table("lineitem").join(
            self.suppliers(), F.col("l_suppkey") == F.col("s_suppkey")
        )

    def bars_of(self, symbol: str, **conditions) -> DataFrame:
        """Lines are merged by supplier and session before the suppliers are joined to them."""
        parts = trades.trade_parts(
            self.table("lineitem"), F.col("l_suppkey"), F.col("l_shipdate"),
            F.col("l_extendedprice"), F.col("l_quantity"), **conditions)
        joined = parts.join(self.suppliers(), F.col("key") == F.col("s_suppkey"))
        return trades.bars_from_parts(joined, F.col(symbol))

    def bars(self) -> DataFrame:
        if self.variant.name == "shaped":
            return shaped.bars(self.table("lineitem"))
        settled = F.col("l_linestatus") == "F" if self.variant.settled else None
        return self.bars_of(self._symbol(), counts_for_close=settled)

    def landed_bars(self, by_symbol: bool = False) -> DataFrame:
        """The bars as a written table, for queries that read them more than once.

        Bucketed by symbol when several window jobs follow, so that only the
        first of them pays for the shuffle.
        """
        if self._bars is None:
            self._bars = (land_by_symbol if by_symbol else land)(self.bars(), "bars")
        return self._bars

    def thinly_traded_bars(self) -> DataFrame:
        """Volumes from lines that were not returned only: some sessions trade nothing."""
        return self.bars_of(self._symbol(), counts_for_volume=F.col("l_returnflag") != "R")

    def benchmark(self) -> DataFrame:
        if self.variant.name == "shaped":
            return shaped.benchmark(self.table("lineitem"))
        return trades.index_from_trades(
            self.table("lineitem"), F.col("l_shipdate"),
            F.col("l_extendedprice"), F.col("l_quantity"),
        )

    def landed_benchmark(self) -> DataFrame:
        """One row per session as a written table: its true size decides the join."""
        if self._benchmark is None:
            self._benchmark = land(self.benchmark(), "benchmark")
        return self._benchmark

    def universe(self) -> DataFrame:
        if self.variant.name == "shaped":
            return shaped.universe(self.spark)
        rows = self.suppliers()
        if self.variant.name == "supplier":
            return rows.select(
                F.col("s_name").alias("Symbol"), F.col("s_name").alias("Company Name"),
                F.col("n_name").alias("Industry"), F.lit("EQ").alias("Series"),
            )
        return rows.select(
            F.col("n_name").alias("Symbol"),
            F.concat(F.lit("Company of "), F.col("n_name")).alias("Company Name"),
            F.col("r_name").alias("Industry"), F.lit("EQ").alias("Series"),
        ).distinct()

    def boundary(self, decision: dt.date = DECISION) -> dt.date:
        return boundary.information_boundary(
            self.landed_bars(), self.universe().count(), decision, self.variant.min_pct
        )
