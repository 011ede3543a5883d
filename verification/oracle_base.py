"""Common table expressions of the SQL side.

Written from the definitions, not from the Spark plans: windows start at a date
that a subquery looks up, and the rows between are joined to it.
"""

from __future__ import annotations

import re

from verification import shaped
from verification.inputs import DECISION, VARIANTS

D = f"DATE '{DECISION.isoformat()}'"


def lines(variant: str = "nation") -> str:
    symbol, industry = ("s_name", "n_name") if variant == "supplier" else ("n_name", "r_name")
    company = "s_name" if variant == "supplier" else "'Company of ' || n_name"
    return f"""
lines AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS v,
         l_quantity AS q, l_linestatus = 'F' AS settled, l_returnflag <> 'R' AS traded
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
universe AS (
  SELECT DISTINCT {symbol} AS "Symbol", {company} AS "Company Name",
         {industry} AS "Industry", 'EQ' AS "Series"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


def bars(variant: str = "nation", volume: str = "true") -> str:
    if variant == "shaped":
        return shaped.sql()
    close = "FILTER (WHERE settled)" if VARIANTS[variant].settled else ""
    return f"""{lines(variant)},
bars AS (
  SELECT symbol, date, sum(v) {close} / sum(q) {close} AS close, max(v / q) AS high,
         min(v / q) AS low, sum(CASE WHEN {volume} THEN q ELSE 0.0 END) AS volume
  FROM lines GROUP BY symbol, date)"""


BENCH = """
bench AS (
  SELECT CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close
  FROM lineitem GROUP BY 1)"""


def bench(variant: str) -> str:
    return shaped.bench_sql() if variant == "shaped" else BENCH


def boundary(variant: str, name: str = "bnd", decision: str = D) -> str:
    pct = VARIANTS[variant].min_pct
    return f"""
{name} AS (
  SELECT max(date) AS b FROM (
    SELECT date, count(*) AS n FROM bars WHERE close IS NOT NULL AND date < {decision}
    GROUP BY date)
  WHERE n >= ceil((SELECT count(*) FROM universe) * {pct} / 100.0))"""


def _asof(rows: str, target: str) -> str:
    return f"(SELECT symbol, max(date) AS s FROM {rows} WHERE date <= {target} GROUP BY symbol)"


def _since(rows: str, target: str, select: str) -> str:
    return f"""(SELECT w.symbol, {select} FROM {rows} w JOIN {_asof(rows, target)} a
    ON w.symbol = a.symbol AND w.date >= a.s GROUP BY w.symbol)"""


def research(variant: str, p: str = "", bnd: str = "bnd", min_sessions: int | None = None) -> str:
    """CTEs ending in {p}research: every published field. `p` prefixes the names."""
    m = VARIANTS[variant].min_sessions if min_sessions is None else min_sessions
    B = f"(SELECT b FROM {bnd})"
    falls = "".join(f""",
{p}dd{k} AS (
  SELECT symbol, CASE WHEN count(*) >= 2 THEN min(close / peak - 1) END AS x FROM (
    SELECT w.symbol, w.close, max(w.close) OVER (PARTITION BY w.symbol ORDER BY w.date) AS peak
    FROM {p}c w JOIN {_asof(f'{p}c', f"{B} - INTERVAL {k} MONTH")} a
    ON w.symbol = a.symbol AND w.date >= a.s) GROUP BY symbol)""" for k in (3, 6, 9, 12))
    blocks = ", ".join(
        f"(max(high) FILTER (WHERE pos BETWEEN {40 - 10 * b} AND {49 - 10 * b})"
        f" - min(low) FILTER (WHERE pos BETWEEN {40 - 10 * b} AND {49 - 10 * b}))"
        f" / avg(close) FILTER (WHERE pos BETWEEN {40 - 10 * b} AND {49 - 10 * b}) * 100 AS b{b}"
        for b in range(5))
    return f"""
{p}k AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) - 1 AS pos,
         count(*) OVER (PARTITION BY b.symbol) AS n,
         lag(close) OVER (PARTITION BY b.symbol ORDER BY b.date) AS pc
  FROM bars b WHERE b.date <= {B} AND b.symbol IN (
    SELECT symbol FROM bars WHERE date = {B} AND close IS NOT NULL)),
{p}c AS (
  SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1 AS cpos,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM {p}k WHERE close IS NOT NULL),
{p}l AS (
  SELECT c.symbol, c.date, c.close / bench.close AS line FROM {p}c c JOIN bench USING (date)
  WHERE bench.close IS NOT NULL AND bench.close <> 0),
{p}ret AS (
  SELECT symbol, arg_max(close, date) AS "Close",
    arg_max(close, date) / arg_max(close, date) FILTER (WHERE date <= {B} - INTERVAL 3 MONTH) - 1 AS r3,
    arg_max(close, date) / arg_max(close, date) FILTER (WHERE date <= {B} - INTERVAL 6 MONTH) - 1 AS r6,
    arg_max(close, date) / arg_max(close, date) FILTER (WHERE date <= {B} - INTERVAL 9 MONTH) - 1 AS r9,
    arg_max(close, date) / arg_max(close, date) FILTER (WHERE date <= {B} - INTERVAL 12 MONTH) - 1 AS r12
  FROM {p}c GROUP BY symbol){falls},
{p}up AS (
  SELECT symbol, 100.0 * count(*) FILTER (WHERE d > 0) / count(d) AS x FROM (
    SELECT w.symbol, w.close - lag(w.close) OVER (PARTITION BY w.symbol ORDER BY w.date) AS d
    FROM {p}c w JOIN {_asof(f'{p}c', f"{B} - INTERVAL 6 MONTH")} a
    ON w.symbol = a.symbol AND w.date >= a.s) GROUP BY symbol HAVING count(d) > 0),
{p}ma30 AS {_since(f'{p}c', f"{B} - 210", "CASE WHEN count(*) >= 2 THEN avg(close) END AS x")},
{p}ma10 AS {_since(f'{p}c', f"{B} - 70", "CASE WHEN count(*) >= 2 THEN avg(close) END AS x")},
{p}t10 AS (SELECT symbol, date AS t FROM {p}c WHERE cpos = 10),
{p}prior AS (
  SELECT w.symbol, avg(w.close) AS x FROM {p}c w JOIN (
    SELECT c.symbol, max(c.date) AS s, any_value(t.t) AS t FROM {p}c c JOIN {p}t10 t USING (symbol)
    WHERE c.date <= t.t - 210 GROUP BY c.symbol) a
  ON w.symbol = a.symbol AND w.date BETWEEN a.s AND a.t GROUP BY w.symbol),
{p}hi AS {_since(f'(SELECT symbol, date, high FROM {p}k WHERE high IS NOT NULL)', f"{B} - 364",
                 f"CASE WHEN count(*) >= {m} THEN max(high) END AS x")},
{p}lo AS {_since(f'(SELECT symbol, date, low FROM {p}k WHERE low IS NOT NULL)', f"{B} - 364",
                 f"CASE WHEN count(*) >= {m} THEN min(low) END AS x")},
{p}lend AS (SELECT symbol, max(date) AS e, arg_max(line, date) AS v FROM {p}l GROUP BY symbol),
{p}lhi AS (
  SELECT w.symbol, CASE WHEN count(*) >= {m} THEN max(w.line) END AS x FROM {p}l w JOIN (
    SELECT l.symbol, max(l.date) AS s FROM {p}l l JOIN {p}lend e USING (symbol)
    WHERE l.date <= e.e - 364 GROUP BY l.symbol) a
  ON w.symbol = a.symbol AND w.date >= a.s GROUP BY w.symbol),
{p}smas AS (
  SELECT symbol,
    CASE WHEN max(n) >= 50 THEN avg(close) FILTER (WHERE cpos < 50) END AS s50,
    CASE WHEN max(n) >= 150 THEN avg(close) FILTER (WHERE cpos < 150) END AS s150,
    CASE WHEN max(n) >= 200 THEN avg(close) FILTER (WHERE cpos < 200) END AS s200,
    CASE WHEN max(n) >= 221 THEN avg(close) FILTER (WHERE cpos BETWEEN 21 AND 220) END AS s200p
  FROM {p}c GROUP BY symbol),
{p}val AS (
  SELECT symbol, CASE WHEN max(n) >= 20 THEN avg(v) FILTER (WHERE rn <= 20) END AS x FROM (
    SELECT symbol, close * volume AS v, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn,
           count(*) OVER (PARTITION BY symbol) AS n
    FROM {p}k WHERE close * volume IS NOT NULL) GROUP BY symbol),
{p}tr AS (
  SELECT symbol, CASE WHEN count(*) >= 14 THEN avg(tr) FILTER (WHERE rn <= 14) END AS x FROM (
    SELECT symbol, tr, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM (
      SELECT symbol, date, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM {p}k)
    WHERE tr IS NOT NULL) GROUP BY symbol),
{p}vol AS (
  SELECT symbol, max(n) AS n, max(volume) FILTER (WHERE pos = 0) AS v0,
    avg(volume) FILTER (WHERE pos BETWEEN 1 AND 50) AS base,
    coalesce(sum(volume) FILTER (WHERE pos < 20 AND close - pc > 0), 0) AS up,
    coalesce(sum(volume) FILTER (WHERE pos < 20 AND close - pc < 0), 0) AS down,
    avg(volume) FILTER (WHERE pos < 10) AS recent,
    avg(volume) FILTER (WHERE pos BETWEEN 10 AND 59) AS dry,
    max(high) FILTER (WHERE pos < 50) AS bh, min(low) FILTER (WHERE pos < 50) AS bl,
    {blocks}
  FROM {p}k GROUP BY symbol),
{p}r0 AS (
  SELECT ret.symbol AS "Symbol", {B} AS "Date", ret."Close",
    CASE WHEN r12 IS NOT NULL THEN r3 END AS "R3M", CASE WHEN r12 IS NOT NULL THEN r6 END AS "R6M",
    CASE WHEN r12 IS NOT NULL THEN r9 END AS "R9M", r12 AS "R12M",
    0.4 * r3 + 0.2 * r6 + 0.2 * r9 + 0.2 * r12 AS "RS_Blend",
    dd3.x AS "MaxDD_3M", dd6.x AS "MaxDD_6M", dd9.x AS "MaxDD_9M", dd12.x AS "MaxDD_12M",
    up.x AS "Up_Days_Pct_6M",
    CASE WHEN prior.x <> 0 THEN ma30.x END AS "MA_30W",
    CASE WHEN prior.x <> 0 THEN (ma30.x / prior.x - 1) * 100 END AS "MA_30W_Slope_10S_Pct",
    ma10.x AS "MA_10W", hi.x AS "High_52W", lo.x AS "Low_52W",
    CASE WHEN vol.n >= 51 THEN CASE WHEN base = 0 THEN CASE WHEN v0 > 0 THEN 'inf'::DOUBLE END
         ELSE v0 / base END END AS "Volume_Ratio",
    CASE WHEN vol.n >= 21 THEN CASE WHEN vol.down = 0 THEN CASE WHEN vol.up > 0 THEN 'inf'::DOUBLE END
         ELSE vol.up / vol.down END END AS "U_D",
    val.x AS "AvgValue20", s50 AS "SMA_50", s150 AS "SMA_150", s200 AS "SMA_200",
    coalesce(s200 > s200p, false) AS "SMA_200_Rising",
    tr.x / nullif(ret."Close", 0) * 100 AS "ATR_Pct",
    CASE WHEN vol.n >= 50 THEN b0 END AS b0, CASE WHEN vol.n >= 50 THEN b1 END AS b1,
    CASE WHEN vol.n >= 50 THEN b2 END AS b2, CASE WHEN vol.n >= 50 THEN b3 END AS b3,
    CASE WHEN vol.n >= 50 THEN b4 END AS b4,
    CASE WHEN vol.n >= 50 AND bh > 0 THEN (bh - bl) / bh * 100 END AS "Base_Depth_Pct",
    CASE WHEN vol.n >= 60 THEN recent / nullif(dry, 0) END AS "Volume_DryUp",
    CASE WHEN vol.n >= 50 THEN bh END AS "VCP_Pivot",
    lend.v AS "RS_Line", lhi.x AS "RS_Line_High_52W"
  FROM {p}ret ret LEFT JOIN {p}dd3 dd3 USING (symbol) LEFT JOIN {p}dd6 dd6 USING (symbol)
  LEFT JOIN {p}dd9 dd9 USING (symbol) LEFT JOIN {p}dd12 dd12 USING (symbol)
  LEFT JOIN {p}up up USING (symbol) LEFT JOIN {p}ma30 ma30 USING (symbol)
  LEFT JOIN {p}ma10 ma10 USING (symbol) LEFT JOIN {p}prior prior USING (symbol)
  LEFT JOIN {p}hi hi USING (symbol) LEFT JOIN {p}lo lo USING (symbol)
  LEFT JOIN {p}vol vol USING (symbol) LEFT JOIN {p}val val USING (symbol)
  LEFT JOIN {p}smas smas USING (symbol) LEFT JOIN {p}tr tr USING (symbol)
  LEFT JOIN {p}lend lend USING (symbol) LEFT JOIN {p}lhi lhi USING (symbol)),
{p}r1 AS (
  SELECT *, CASE WHEN b0 IS NULL OR b1 IS NULL OR b2 IS NULL OR b3 IS NULL OR b4 IS NULL THEN 0
      ELSE (b1 < b0)::INT + (b2 < b1)::INT + (b3 < b2)::INT + (b4 < b3)::INT END AS "VCP_Contractions",
    CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL AND b3 IS NOT NULL THEN b4 / nullif(b0, 0) END
      AS "Contraction_Ratio",
    CASE WHEN "MA_30W" IS NULL THEN NULL
      WHEN "Close" > "MA_30W" AND "MA_30W_Slope_10S_Pct" > 0 THEN 'Stage 2 — Advancing'
      WHEN "Close" > "MA_30W" THEN 'Stage 3 — Topping'
      WHEN "MA_30W_Slope_10S_Pct" > 0 THEN 'Stage 1 — Basing' ELSE 'Stage 4 — Declining' END AS "Stage",
    CASE WHEN "RS_Blend" IS NOT NULL THEN round_even(
      rank() OVER (PARTITION BY "RS_Blend" IS NULL ORDER BY "RS_Blend")
      / count(*) OVER (PARTITION BY "RS_Blend" IS NULL) * 98.0 + 1.0, 0) END AS "RS_Score",
    coalesce("Close" >= 0.97 * "High_52W", false) AS "Near_52W_High",
    coalesce("RS_Line_High_52W" <> 0 AND "RS_Line" >= "RS_Line_High_52W" * 0.995, false) AS "RS_Line_At_High",
    ("VCP_Pivot" / nullif("Close", 0) - 1) * 100 AS "Pct_To_Pivot",
    coalesce("Close" < "SMA_50", false) AS "Below_50DMA",
    ("Close" / nullif("MA_30W", 0) - 1) * 100 AS "Ext_Pct",
    coalesce("Close" > 1.20 * "MA_30W", false) AS "Extended_20Pct",
    ("Close" / nullif("High_52W", 0) - 1) * 100 AS "Pct_From_52W_High",
    coalesce("Close" > "MA_30W", false) AS "Above_MA_30W",
    coalesce("Close" > "MA_10W", false) AS "Above_MA_10W",
    coalesce("MA_10W" > "MA_30W", false) AS "MA10W_Above_MA30W",
    coalesce("MA_30W_Slope_10S_Pct" > 0, false) AS "MA_30W_Rising",
    coalesce("U_D" < 0.7, false) AS "Distribution",
    coalesce("U_D" < 0.6, false) AS "Heavy_Distribution",
    coalesce("AvgValue20" > 5e7, false) AS "Liquid_UI_Filter"
  FROM {p}r0),
{p}r2 AS (
  SELECT *, split_part("Stage", ' — ', 1) AS sk,
    coalesce("Stage" LIKE 'Stage 2%' AND "Near_52W_High" AND "Volume_Ratio" > 1.5, false) AS "Breakout",
    coalesce("Stage" LIKE 'Stage 2%' AND "Near_52W_High" AND "Volume_Ratio" > 1.5 AND "U_D" > 1.3,
      false) AS "Breakout_Confirmed",
    coalesce("RS_Score" >= 50, false) AS "RS_Not_Lagging",
    coalesce("Contraction_Ratio" <= 0.6 AND "Volume_DryUp" <= 0.8 AND "VCP_Contractions" >= 2
      AND "Stage" LIKE 'Stage 2%' AND "Base_Depth_Pct" <= 35, false) AS "VCP_Setup",
    "RS_Line_At_High" AND coalesce("Pct_From_52W_High" <= -5, false) AS "RS_Line_NH_Before_Price",
    CASE WHEN "Stage" LIKE 'Stage 1%' THEN (
      coalesce("MA_30W_Slope_10S_Pct" >= -0.1, false)::INT + coalesce("RS_Score" >= 50, false)::INT
      + coalesce("Contraction_Ratio" <= 0.7, false)::INT + coalesce("Volume_DryUp" <= 0.9, false)::INT
      + coalesce("Close" > "MA_10W", false)::INT)::DOUBLE END AS "Stage1_Readiness",
    coalesce("Close" > "SMA_150" AND "Close" > "SMA_200", false) AS "TT1_Above_150_200",
    coalesce("SMA_150" > "SMA_200", false) AS "TT2_150_Above_200",
    "SMA_200_Rising" AS "TT3_200_Rising",
    coalesce("SMA_50" > "SMA_150" AND "SMA_50" > "SMA_200", false) AS "TT4_50_Above_150_200",
    coalesce("Close" > "SMA_50", false) AS "TT5_Above_50",
    coalesce("Close" >= "Low_52W" * 1.3, false) AS "TT6_Above_52W_Low",
    coalesce("Close" >= "High_52W" * 0.75, false) AS "TT7_Near_52W_High",
    coalesce("RS_Score" >= 70, false) AS "TT8_RS"
  FROM {p}r1),
{p}r3 AS (
  SELECT *,
    "Above_MA_30W"::INT + "MA_30W_Rising"::INT + "MA10W_Above_MA30W"::INT + "Above_MA_10W"::INT
      + "RS_Not_Lagging"::INT AS "Trend_Health",
    "TT1_Above_150_200"::INT + "TT2_150_Above_200"::INT + "TT3_200_Rising"::INT
      + "TT4_50_Above_150_200"::INT + "TT5_Above_50"::INT + "TT6_Above_52W_Low"::INT
      + "TT7_Near_52W_High"::INT + "TT8_RS"::INT AS "Trend_Template_Score",
    CASE WHEN sk = 'Stage 4' THEN 'SELL'
      WHEN sk = 'Stage 3' THEN CASE WHEN "RS_Score" < 50 THEN 'SELL' ELSE 'REDUCE' END
      WHEN sk = 'Stage 1' THEN CASE WHEN "RS_Score" >= 80 THEN 'WATCH★'
        WHEN "RS_Score" >= 50 THEN 'WATCH' ELSE 'AVOID' END
      WHEN sk IS NULL OR sk <> 'Stage 2' THEN 'WAIT'
      WHEN "U_D" < 0.7 THEN 'REDUCE'
      WHEN "RS_Score" IS NULL OR "RS_Score" < 50 THEN 'WAIT'
      WHEN "RS_Score" < 80 THEN CASE WHEN "Breakout" THEN 'WAIT' ELSE 'HOLD' END
      WHEN "Extended_20Pct" OR "Below_50DMA" THEN 'WAIT'
      WHEN "Breakout_Confirmed" THEN 'BUY★' WHEN "Breakout" THEN 'BUY' ELSE 'HOLD' END AS "Action"
  FROM {p}r2),
{p}research AS (
  SELECT r.*, r."Trend_Template_Score" = 8 AS "Trend_Template_Pass",
    u."Company Name", u."Industry", u."Series"
  FROM {p}r3 r LEFT JOIN universe u ON r."Symbol" = u."Symbol")"""


def snapshot(variant: str, min_sessions: int | None = None) -> str:
    return (f"WITH {bars(variant)}, {bench(variant)}, {boundary(variant)}, "
            f"{research(variant, min_sessions=min_sessions)}")


def two_snapshots(variant: str) -> str:
    """Both snapshots; the earlier one ranks the symbols of the later one only."""
    earlier = re.sub(r"\bbars\b", "kept_bars", research(variant, p="p_", bnd="bnd2"))
    return f"""{snapshot(variant)}, {boundary(variant, 'bnd2', '(SELECT b FROM bnd)')},
kept_bars AS (SELECT * FROM bars WHERE symbol IN (SELECT "Symbol" FROM research)), {earlier}"""
