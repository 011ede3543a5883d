"""Plain pandas definitions, one symbol at a time, to test the window plans against."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

NAN = float("nan")


def asof(index: pd.DatetimeIndex, target: pd.Timestamp):
    before = index[index <= target]
    return before[-1] if len(before) else None


def window(s: pd.Series, end: pd.Timestamp, back) -> pd.Series | None:
    start = asof(s.index, end - back)
    return None if start is None else s.loc[start:end]


def mean_at(close: pd.Series, t: pd.Timestamp, weeks: int) -> float:
    w = window(close, t, pd.Timedelta(weeks=weeks))
    return NAN if w is None or len(w) < 2 else w.mean()


def ratio(part: float, base: float) -> float:
    if base == 0:
        return math.inf if part > 0 else NAN
    return part / base


def indicators(frame: pd.DataFrame, benchmark: pd.Series | None = None, minimum: int = 200) -> dict:
    f = frame.set_index("date").sort_index()
    last = f["close"].dropna().index[-1]
    f = f.loc[:last]
    c = f["close"].dropna()
    t = c.index[-1]
    out: dict[str, float] = {"Close": c.iloc[-1]}

    refs = {m: asof(c.index, t - pd.DateOffset(months=m)) for m in (3, 6, 9, 12)}
    complete = all(r is not None for r in refs.values())
    for m, r in refs.items():
        out[f"R{m}M"] = c.iloc[-1] / c.loc[r] - 1 if complete else NAN
        out[f"MaxDD_{m}M"] = NAN
        if r is not None and len(c.loc[r:t]) >= 2:
            w = c.loc[r:t]
            out[f"MaxDD_{m}M"] = (w / w.cummax() - 1).min()
    out["RS_Blend"] = (
        .4 * out["R3M"] + .2 * out["R6M"] + .2 * out["R9M"] + .2 * out["R12M"] if complete else NAN
    )
    out["Up_Days_Pct_6M"] = NAN
    if refs[6] is not None and len(c.loc[refs[6]:t]) >= 2:
        steps = c.loc[refs[6]:t].diff().dropna()
        out["Up_Days_Pct_6M"] = (steps > 0).mean() * 100

    line = pd.Series({d: mean_at(c, d, 30) for d in c.index}).dropna()
    ma = mean_at(c, t, 30)
    slope = (line.iloc[-1] / line.iloc[-11] - 1) * 100 if len(line) >= 11 else NAN
    out["MA_30W"], out["MA_30W_Slope_10S_Pct"] = (NAN, NAN) if math.isnan(slope) else (ma, slope)
    out["MA_10W"] = mean_at(c, t, 10)
    for name, key, best in (("High_52W", "high", "max"), ("Low_52W", "low", "min")):
        s = f[key].dropna()
        w = window(s, s.index[-1], pd.Timedelta(weeks=52)) if len(s) else None
        out[name] = NAN if w is None or len(w) < minimum else getattr(w, best)()

    v = f["volume"]
    out["Volume_Ratio"] = ratio(v.iloc[-1], v.iloc[-51:-1].mean()) if len(v) >= 51 else NAN
    d = f["close"].diff().iloc[-20:]
    up, down = v.iloc[-20:][d > 0].sum(), v.iloc[-20:][d < 0].sum()
    out["U_D"] = ratio(up, down) if len(v) >= 21 else NAN
    value = (f["close"] * v).dropna()
    out["AvgValue20"] = value.iloc[-20:].mean() if len(value) >= 20 else NAN
    for n in (50, 150, 200):
        out[f"SMA_{n}"] = c.iloc[-n:].mean() if len(c) >= n else NAN
    sma = c.rolling(200).mean().dropna()
    out["SMA_200_Rising"] = bool(len(sma) > 21 and sma.iloc[-1] > sma.iloc[-22])

    prev = f["close"].shift(1)
    tr = pd.concat(
        [f["high"] - f["low"], (f["high"] - prev).abs(), (f["low"] - prev).abs()], axis=1
    ).max(axis=1).dropna()
    out["ATR_Pct"] = tr.iloc[-14:].mean() / c.iloc[-1] * 100 if len(tr) >= 14 else NAN
    blocks = [NAN] * 5
    if len(f) >= 50:
        base = f.iloc[-50:]
        parts = [base.iloc[i:i + 10] for i in range(0, 50, 10)]
        means = [p["close"].mean() for p in parts]
        if all(np.isfinite(means)):
            blocks = [(p["high"].max() - p["low"].min()) / m * 100 for p, m in zip(parts, means)]
    out["VCP_Contractions"] = sum(b < a for a, b in zip(blocks, blocks[1:]))
    out["Contraction_Ratio"] = blocks[4] / blocks[0] if blocks[0] else NAN
    out["Base_Depth_Pct"] = out["VCP_Pivot"] = NAN
    if len(f) >= 50:
        hi, lo = f["high"].iloc[-50:].max(), f["low"].iloc[-50:].min()
        out["VCP_Pivot"], out["Base_Depth_Pct"] = hi, (hi - lo) / hi * 100
    out["Volume_DryUp"] = v.iloc[-10:].mean() / v.iloc[-60:-10].mean() if len(v) >= 60 else NAN

    out["RS_Line"] = out["RS_Line_High_52W"] = NAN
    if benchmark is not None:
        joined = pd.concat([c, benchmark], axis=1, join="inner").dropna()
        rs = joined.iloc[:, 0] / joined.iloc[:, 1]
        if len(rs):
            out["RS_Line"] = rs.iloc[-1]
            w = window(rs, rs.index[-1], pd.Timedelta(weeks=52))
            out["RS_Line_High_52W"] = NAN if w is None or len(w) < minimum else w.max()
    return out
