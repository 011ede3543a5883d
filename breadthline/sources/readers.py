"""Readers of the landed inputs and of the published tables."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breadthline.functions import rules, text
from breadthline.functions.numbers import number
from breadthline.operators import boundary, universe
from breadthline.sources.sinks import published

V21_FIELDS = ("Close", "MA_10W", "Low_52W", "Ext_Pct", "Pct_From_52W_High", "Trend_Health")
V22_FIELDS = (
    "RS_Line", "RS_Line_NH_Before_Price", "Contraction_Ratio", "Volume_DryUp", "VCP_Setup",
    "Pct_To_Pivot", "Trend_Template_Score", "Stage1_Readiness",
)


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text; types are given by the caller, not guessed."""
    return spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")


def read_constituents(spark: SparkSession, path: str) -> DataFrame:
    """The universe file: Symbol and Industry required, DUMMY symbols left out."""
    return universe.check_universe(_read_csv(spark, path))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_csv(spark, path)
    clean = raw.toDF(*[n.lstrip("\ufeff").strip() for n in raw.columns])
    return universe.candidates(clean)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars as Parquet; dates and missing values normalised once, here."""
    return boundary.normalize_bars(boundary.validate_columns(spark.read.parquet(path)))


def _header(names: list[str], separator: str) -> tuple[list[str], dict[str, list[int]]]:
    """Tickers of the columns 'TICKER|Field', and per field the place of each ticker's column or -1."""
    at: dict[str, dict[str, int]] = {}
    for place, name in enumerate(names):
        if separator in name:
            ticker, measure = name.split(separator, 1)
            at.setdefault(ticker, {})[measure.strip().lower()] = place
    if not at:
        raise ValueError("the response has no ticker-level columns")
    measures = sorted({m for fields in at.values() for m in fields})
    return list(at), {m: [fields.get(m, -1) for fields in at.values()] for m in measures}


def _paired(rows: DataFrame, names: list[str], separator: str) -> DataFrame:
    """Bars of rows (date, cells), the cells paired with their ticker and field by position.

    One expression for each field walks over the tickers, so the plan is the same for ten tickers
    and for thousands; one explode turns a row into one row per ticker, and nothing is shuffled.
    """
    tickers, places = _header(names, separator)

    def constant(values: list, kind: str) -> Column:
        # One literal, whatever its length.
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")

    def cell(measure: str, i: Column) -> Column:
        place = F.get(constant(places[measure], "int"), i)
        return F.when(place >= 0, F.get("cells", place)).alias(measure)

    per_ticker = F.transform(constant(tickers, "string"), lambda ticker, i: F.struct(
        ticker.alias("symbol"), *[cell(m, i) for m in places]))
    long = rows.select("date", F.inline(per_ticker))
    anything = F.coalesce(*[F.col(m) for m in places]).isNotNull()
    return long.filter(anything)


def long_bars(wide: DataFrame, date: str = "Date", separator: str = "|") -> DataFrame:
    """A wide multi-ticker table (columns 'TICKER|Field') as long bars."""
    names = [n for n in wide.columns if separator in n]
    cells = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    return _paired(wide.select(F.col(date).cast("date").alias("date"), cells.alias("cells")),
                   names, separator)


def read_wide_response(spark: SparkSession, path: str, date: str = "Date",
                       separator: str = "|") -> DataFrame:
    """A wide multi-ticker response as it comes (CSV lines under one header) as long bars.

    Lines are cut into cells, so not even the schema grows with the tickers. Every file repeats the
    header. Cells are numbers or empty; anything else in them counts as missing.
    """
    lines = spark.read.text(path).select(F.rtrim("value", F.lit("\r\n ")).alias("line"))
    header = lines.filter(F.col("line").startswith(date) | F.col("line").startswith(f'"{date}"')).first()
    if header is None:
        raise ValueError(f"the response has no header with {date}")
    names = next(csv.reader([header["line"]]))
    cells = F.split("line", ",", -1)
    rows = lines.filter((F.col("line") != header["line"]) & (F.col("line") != "")).select(
        F.to_date(F.substring(F.trim(F.get(cells, F.lit(names.index(date))), F.lit('"')), 1, 10))
        .alias("date"),
        F.transform(cells, lambda x: F.trim(x, F.lit('"')).try_cast("double")).alias("cells"))
    return _paired(rows, names, separator)


def enriched_research(research: DataFrame, constituents: DataFrame) -> DataFrame:
    """Names and industries filled from the universe; stage key and action derived again."""
    names = [n for n in ("Industry", "Company Name") if n in constituents.columns]
    lookup = constituents.groupBy("Symbol").agg(
        *[F.first(f"`{n}`", ignorenulls=True).alias(f"_u_{n}") for n in names]
    )
    rows = research.withColumn("Symbol", F.trim(F.col("Symbol").cast("string")))
    rows = rows.join(lookup, "Symbol", "left")
    for n in names:
        own = F.col(f"`{n}`") if n in research.columns else F.lit(None).cast("string")
        rows = rows.withColumn(n, F.coalesce(own, F.col(f"`_u_{n}`")))
    rows = rows.drop(*[f"_u_{n}" for n in names])
    rows = rows.withColumns({"Stage_Label": rules.stage_key("Stage"), "Action": rules.action()})
    return rows.withColumn("Action_Reason", text.action_reason())


def typed_research(raw: DataFrame) -> DataFrame:
    """Text columns of a snapshot CSV as numbers, dates and flags."""
    texts = {
        "Symbol", "Stage", "Company Name", "Industry", "Series", "Action", "Action_Reason",
        "Corporate_Action_Date", "Corporate_Action_Kind", "Stage_Label",
    }
    flags = {
        "Near_52W_High", "SMA_200_Rising", "RS_Line_At_High", "VCP_Setup", "Below_50DMA",
        "Extended_20Pct", "Above_MA_30W", "Above_MA_10W", "MA10W_Above_MA30W", "MA_30W_Rising",
        "Distribution", "Heavy_Distribution", "Breakout", "Breakout_Confirmed",
        "Liquid_UI_Filter", "RS_Not_Lagging", "Trend_Template_Pass", "RS_Line_NH_Before_Price",
        "Corporate_Action",
    }
    columns = []
    for n in raw.columns:
        value = F.col(f"`{n}`")
        if n == "Date":
            columns.append(F.try_to_date(value).alias(n))
        elif n in flags or n.startswith("TT"):
            columns.append((F.lower(F.trim(value)).isin("true", "1")).alias(n))
        elif n in texts:
            columns.append(value)
        else:
            columns.append(number(value).alias(n))
    return raw.select(*columns)


def read_research(spark: SparkSession, path: str, constituents: DataFrame) -> DataFrame:
    if path.endswith((".csv", ".csv.gz")):
        raw = typed_research(_read_csv(spark, path))
    else:
        raw = spark.read.parquet(path)
    return enriched_research(raw, constituents)


def clean_breadth(raw: DataFrame) -> DataFrame:
    """Rows with a real date, in date order."""
    date = "Date" if "Date" in raw.columns else "date"
    parsed = raw.withColumn(date, F.try_to_date(F.col(date).cast("string")))
    return parsed.filter(F.col(date).isNotNull()).orderBy(date)


def read_breadth(spark: SparkSession, path: str) -> DataFrame:
    raw = _read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)
    text_columns = {"Date", "date", "Benchmark_Ticker", "benchmark_ticker"}
    typed = raw.select(*[
        F.col(n) if n in text_columns else number(n).alias(n) for n in raw.columns
    ])
    return clean_breadth(typed)


@dataclass
class Snapshot:
    """The published set: tables, and what is missing from it and why."""

    research: DataFrame
    universe: DataFrame
    previous: DataFrame | None = None
    breadth: DataFrame | None = None
    missing: dict[str, str] = field(default_factory=dict)

    def has(self, *columns: str) -> bool:
        return all(n in self.research.columns for n in columns)


def load_snapshot(spark: SparkSession, folder: str, constituents: DataFrame) -> Snapshot:
    """The published set of a folder; all of its tables are of one run.

    The commit log is read once, so a run that publishes meanwhile does not mix into the set.
    """
    tables = published(spark, folder)
    if tables is None:
        raise FileNotFoundError(f"nothing has been published in {folder}")
    research = read_research(spark, tables["research"], constituents)
    snapshot = Snapshot(research=research, universe=constituents)
    for key, names in (("v21_fields", V21_FIELDS), ("v22_fields", V22_FIELDS)):
        absent = [n for n in names if n not in research.columns]
        if absent:
            snapshot.missing[key] = f"This snapshot carries no {', '.join(absent)}."
    if "previous" in tables:
        snapshot.previous = read_research(spark, tables["previous"], constituents)
    else:
        snapshot.missing["previous"] = (
            "No previous-session snapshot has been published, so changes cannot be computed."
        )
    if "breadth" in tables:
        snapshot.breadth = read_breadth(spark, tables["breadth"])
    else:
        snapshot.missing["breadth"] = (
            "No breadth history has been published, so the trend cannot be drawn."
        )
    return snapshot
