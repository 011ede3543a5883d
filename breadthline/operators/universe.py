"""Maintaining the list of symbols: candidates, liquidity, admission, removal."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breadthline import config as c


class UniverseError(ValueError):
    """The list breaks one of its own rules."""


def check_universe(raw: DataFrame) -> DataFrame:
    """Constituents with Symbol and Industry, unique, without reserved DUMMY symbols."""
    missing = sorted({"Symbol", "Industry"} - set(raw.columns))
    if missing:
        raise UniverseError(f"constituents miss required columns: {missing}")
    trimmed = raw.withColumn("Symbol", F.trim("Symbol"))
    found = trimmed.agg(
        F.count_if(F.col("Symbol").isNull() | F.col("Industry").isNull()).alias("missing"),
        F.count_if(F.col("Symbol") == "").alias("empty"),
    ).first()
    if found["missing"]:
        raise UniverseError("constituents contain missing Symbol or Industry values")
    if found["empty"]:
        raise UniverseError("constituents contain empty Symbol values")
    if _repeated(trimmed):
        raise UniverseError("constituents contain duplicate symbols")
    return trimmed.filter(~F.col("Symbol").startswith("DUMMY"))


def _repeated(rows: DataFrame) -> bool:
    counts = rows.groupBy("Symbol").agg(F.count(F.lit(1)).alias("n"))
    return bool(counts.filter(F.col("n") > 1).limit(1).count())


def provider_symbol(symbol):
    """The provider's ticker of a symbol: the .NS suffix, once; empty gives NULL."""
    name = F.trim(F.col(symbol) if isinstance(symbol, str) else symbol)
    return F.when(name == "", None).when(F.upper(name).endswith(".NS"), name).otherwise(
        F.concat(name, F.lit(".NS"))
    )


def _listed_symbol(identifier):
    name = F.upper(F.trim(F.substr(F.trim(identifier), F.lit(5))))
    return F.replace(name, F.lit("_"), F.lit("-"))


def _id_column(raw: DataFrame, *accepted: str) -> str:
    by_lower = {n.lower(): n for n in raw.columns}
    for name in accepted:
        if name in by_lower:
            return by_lower[name]
    raise UniverseError("candidate list needs company_id, name and industry columns")


def candidates(raw: DataFrame) -> DataFrame:
    """NSE rows of a candidate list as Symbol, Company Name, Industry; one row per symbol.

    Of several rows for one symbol the alphabetically first is kept: a file's
    row order does not survive a distributed read.
    """
    ids = F.coalesce(F.col(_id_column(raw, "company_id", "companyid")), F.lit(""))
    name = F.coalesce(F.col(_id_column(raw, "name")), F.lit(""))
    industry = F.coalesce(F.col(_id_column(raw, "industry")), F.lit(""))
    listed = raw.filter(F.upper(F.trim(ids)).startswith("NSE:")).select(
        _listed_symbol(ids).alias("Symbol"),
        F.regexp_replace(F.trim(name), r"\s+Limited$", " Ltd").alias("Company Name"),
        F.trim(industry).alias("Industry"),
    )
    return listed.filter(F.col("Symbol") != "").groupBy("Symbol").agg(
        F.min(F.struct("Company Name", "Industry")).alias("row")
    ).select("Symbol", "row.*")


def listed_symbols(raw: DataFrame) -> DataFrame:
    ids = F.coalesce(F.col(_id_column(raw, "company_id", "companyid")), F.lit(""))
    return raw.filter(F.upper(F.trim(ids)).startswith("NSE:")).select(
        _listed_symbol(ids).alias("Symbol")
    ).distinct()


def session_calendar(bars: DataFrame) -> DataFrame:
    """Every date on which any symbol has a close."""
    return bars.filter(F.col("close").isNotNull()).select("date").distinct()


def liquidity(
    bars: DataFrame, window: int = c.LIQUIDITY_WINDOW, ratio: float = c.LIQUIDITY_RATIO,
    min_sample: int = c.LIQUIDITY_MIN_SAMPLE,
) -> DataFrame:
    """Traded against possible sessions of the recent calendar, and who is admitted.

    The recent calendar is an array of at most `window` dates, so "possible
    since the first session" is a count inside it and no range join is needed.
    """
    recent = session_calendar(bars).orderBy(F.desc("date")).limit(window).agg(
        F.sort_array(F.collect_list("date"))
    ).scalar()
    rows = bars.withColumn("_recent", recent)
    close = F.col("close").isNotNull()
    counted = rows.groupBy("symbol").agg(
        F.min(F.when(close, F.col("date"))).alias("first_session"),
        F.count_if(close & (F.col("date") >= F.col("_recent")[0])).alias("traded"),
    ).withColumn("_recent", recent)
    possible = F.size(F.filter("_recent", lambda d: d >= F.col("first_session")))
    possible = F.when(F.col("first_session").isNull(), 0).otherwise(possible)
    return counted.withColumn("possible", possible).select(
        "symbol", "first_session", "traded", "possible",
        ((F.col("possible") >= min_sample) & (F.col("traded") >= ratio * F.col("possible")))
        .alias("admitted"),
    )


def merge(universe: DataFrame, additions: DataFrame,
          allow_sectors: Iterable[str] = ()) -> DataFrame:
    """The universe plus new symbols; existing rows stand, unknown sectors are refused."""
    new = additions.join(universe.select("Symbol"), "Symbol", "left_anti")
    known = universe.select("Industry").distinct()
    strange = new.join(known, "Industry", "left_anti")
    allowed = list(allow_sectors)
    if allowed:
        strange = strange.filter(~F.col("Industry").isin(*allowed))
    bad = [r[0] for r in strange.select("Industry").distinct().orderBy("Industry").take(20)]
    if bad:
        raise UniverseError(f"unknown sector value(s): {bad}")
    if _repeated(new):
        raise UniverseError("duplicate symbol after merge")
    new = new.withColumn("Series", F.lit("EQ"))
    return universe.unionByName(new.select(*[F.col(f"`{n}`") for n in universe.columns]))


def restrict(universe: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) when only the allowed symbols may stay."""
    return (
        universe.join(allowed.select("Symbol"), "Symbol", "left_semi"),
        universe.join(allowed.select("Symbol"), "Symbol", "left_anti"),
    )


def remove(universe: DataFrame, unwanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) when the unwanted symbols must go."""
    return (
        universe.join(unwanted.select("Symbol"), "Symbol", "left_anti"),
        universe.join(unwanted.select("Symbol"), "Symbol", "left_semi"),
    )
