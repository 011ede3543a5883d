from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = "symbol string, date date, close double, high double, low double, volume double"


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def bars_of(spark, frame: pd.DataFrame):
    """A bars DataFrame; NaN becomes NULL."""
    rows = frame.copy()
    rows["date"] = pd.to_datetime(rows["date"]).dt.date
    for n in ("close", "high", "low", "volume"):
        if n not in rows:
            rows[n] = rows["close"] if n != "volume" else 100.0
    out = spark.createDataFrame(rows[["symbol", "date", "close", "high", "low", "volume"]], BARS)
    return out.select("symbol", "date", *[
        F.when(~F.isnan(n), F.col(n)).alias(n) for n in ("close", "high", "low", "volume")
    ])


def series(symbol: str, start: str, closes: list[float], freq: str = "D", volume=100.0):
    dates = pd.date_range(start, periods=len(closes), freq=freq)
    return pd.DataFrame({"symbol": symbol, "date": dates, "close": closes, "volume": volume})


def walk(symbol: str, seed: int, sessions: int = 620, end: str = "2026-08-21", gaps: float = 0.0,
         blanks: float = 0.0) -> pd.DataFrame:
    """A random walk on business days, with absent days and rows without values."""
    rng = np.random.default_rng(seed)
    dates = pd.bdate_range(end=end, periods=sessions)
    close = np.maximum(5.0, 200 + np.cumsum(rng.normal(0.35, 3, sessions)))
    out = pd.DataFrame({
        "symbol": symbol, "date": dates, "close": close, "high": close * 1.012,
        "low": close * 0.988, "volume": rng.uniform(4e5, 3e6, sessions),
    })
    if blanks:
        for n in ("close", "high", "low", "volume"):
            hit = rng.random(sessions) < blanks
            hit[-1] = False
            out.loc[hit, n] = np.nan
    if gaps:
        keep = rng.random(sessions) >= gaps
        keep[-1] = True
        out = out[keep]
    return out.reset_index(drop=True)


SNAPSHOT_FIELDS = {
    "Symbol": "string", "Date": "date", "Close": "double", "Stage": "string", "RS_Score": "double",
    "U_D": "double", "Volume_Ratio": "double", "High_52W": "double", "Low_52W": "double",
    "MA_30W": "double", "MA_10W": "double", "MA_30W_Slope_10S_Pct": "double", "SMA_50": "double",
    "SMA_150": "double", "SMA_200": "double", "SMA_200_Rising": "boolean", "Ext_Pct": "double",
    "Extended_20Pct": "boolean", "Below_50DMA": "boolean", "Breakout": "boolean",
    "Breakout_Confirmed": "boolean", "Above_MA_30W": "boolean", "Above_MA_10W": "boolean",
    "Near_52W_High": "boolean", "Distribution": "boolean", "VCP_Setup": "boolean",
    "VCP_Contractions": "int", "Contraction_Ratio": "double", "Volume_DryUp": "double",
    "Base_Depth_Pct": "double", "RS_Line": "double", "RS_Line_High_52W": "double",
    "RS_Line_At_High": "boolean", "RS_Line_NH_Before_Price": "boolean",
    "Pct_From_52W_High": "double", "Trend_Template_Pass": "boolean",
    "Stage1_Readiness": "double", "Liquid_UI_Filter": "boolean", "R3M": "double",
    "Industry": "string", "Action": "string",
}


def snapshot_of(spark, rows: list[dict], drop: tuple[str, ...] = ()):
    """Snapshot rows with the named fields; all others are NULL."""
    schema = T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in SNAPSHOT_FIELDS.items()))
    full = [tuple(row.get(n) for n in SNAPSHOT_FIELDS) for row in rows]
    return spark.createDataFrame(full, schema).drop(*drop)


def by_symbol(df, column: str) -> dict:
    key = "Symbol" if "Symbol" in df.columns else "symbol"
    return {r[key]: r[column] for r in df.select(key, column).collect()}
