"""Swing detectors as recursive SQL: one step per session, all symbols side by side."""

from __future__ import annotations

from verification import oracle_base as o
from verification.inputs import DECISION


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


def numbered(variant: str, where: str = "true") -> str:
    return f"""{_recursive(f"WITH {o.bars(variant)}")}, numbered AS (
      SELECT symbol, date, high, low, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i
      FROM bars WHERE high IS NOT NULL AND low IS NOT NULL AND {where})"""


def swings(variant: str = "nation", pct: float = 1.5) -> str:
    f = pct / 100.0
    return f"""{numbered(variant)},
    z AS (
      SELECT symbol, 1::BIGINT AS i, 0 AS dir, high AS hp, date AS hd, low AS lp, date AS ld,
        NULL::DOUBLE AS price, NULL::DATE AS date, NULL::VARCHAR AS kind FROM numbered WHERE i = 1
      UNION ALL
      SELECT symbol, ni, CASE WHEN down THEN -1 WHEN up THEN 1 ELSE dir END,
        CASE WHEN up THEN nh ELSE hp2 END, CASE WHEN up THEN nd ELSE hd2 END,
        CASE WHEN down THEN nl ELSE lp2 END, CASE WHEN down THEN nd ELSE ld2 END,
        CASE WHEN down THEN hp2 WHEN up THEN lp2 END, CASE WHEN down THEN hd2 WHEN up THEN ld2 END,
        CASE WHEN down THEN 'H' WHEN up THEN 'L' END
      FROM (SELECT *, NOT ext AND dir >= 0 AND nl <= hp2 * (1 - {f}) AS down,
          NOT ext AND NOT (dir >= 0 AND nl <= hp2 * (1 - {f})) AND dir <= 0
            AND nh >= lp2 * (1 + {f}) AS up
        FROM (SELECT z.symbol, z.dir, n.i AS ni, n.high AS nh, n.low AS nl, n.date AS nd,
            CASE WHEN dir >= 0 AND n.high > hp THEN n.high ELSE hp END AS hp2,
            CASE WHEN dir >= 0 AND n.high > hp THEN n.date ELSE hd END AS hd2,
            CASE WHEN dir <= 0 AND n.low < lp THEN n.low ELSE lp END AS lp2,
            CASE WHEN dir <= 0 AND n.low < lp THEN n.date ELSE ld END AS ld2,
            (dir = 1 AND n.high > hp) OR (dir = -1 AND n.low < lp) AS ext
          FROM z JOIN numbered n ON n.symbol = z.symbol AND n.i = z.i + 1))),
    ends AS (SELECT symbol, max(i) AS i FROM numbered GROUP BY symbol HAVING max(i) >= 2),
    found AS (
      SELECT symbol, i, 0 AS late, date, price, kind FROM z WHERE kind IS NOT NULL UNION ALL
      SELECT symbol, i, 1, CASE WHEN dir = 1 THEN hd ELSE ld END, CASE WHEN dir = 1 THEN hp ELSE lp END,
        CASE WHEN dir = 1 THEN 'H' ELSE 'L' END FROM z JOIN ends USING (symbol, i) WHERE dir <> 0),
    swings AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i, late) - 1 AS seq,
      date, price, kind FROM found)"""


DEPTHS = """depths AS (
  SELECT symbol, date AS peak_date, (price - np) / price * 100 AS depth_pct FROM (
    SELECT *, lead(price) OVER w AS np, lead(kind) OVER w AS nk FROM swings
    WINDOW w AS (PARTITION BY symbol ORDER BY seq))
  WHERE kind = 'H' AND nk = 'L' AND price > 0)"""


def cascade(runs: str) -> str:
    """Legs per run. `runs` yields (run, i, date, high, low, initial), i from 1."""
    return f"""{runs},
    tops AS (SELECT run, arg_min(i, (-high, i)) AS s, max(i) AS n FROM runs GROUP BY run),
    k AS (
      SELECT r.run, r.i, r.high AS peak, r.date AS pd, r.low AS trough, r.initial AS thr, true AS falling,
        []::STRUCT(d DATE, p DOUBLE, x DOUBLE)[] AS legs
      FROM runs r JOIN tops t ON t.run = r.run AND t.s = r.i WHERE t.n >= 3 AND t.s < t.n - 1
      UNION ALL
      SELECT run, ni, CASE WHEN done OR (NOT falling AND nh > peak) THEN nh ELSE peak END,
        CASE WHEN done OR (NOT falling AND nh > peak) THEN nd ELSE pd END,
        CASE WHEN turns THEN nl ELSE t2 END, CASE WHEN done THEN greatest(1.5, x * 0.25) ELSE thr END,
        CASE WHEN done THEN false WHEN turns THEN true ELSE falling END,
        CASE WHEN NOT done THEN legs WHEN len(legs) > 0 AND x >= legs[-1].x
          THEN [{{'d': pd, 'p': peak, 'x': x}}] ELSE list_append(legs, {{'d': pd, 'p': peak, 'x': x}}) END
      FROM (SELECT *, (peak - t2) / peak * 100 AS x,
          falling AND peak > 0 AND nh >= t2 * (1 + thr / 100) AS done,
          NOT falling AND nl <= greatest(peak, nh) * (1 - thr / 100) AS turns
        FROM (SELECT k.*, r.i AS ni, r.high AS nh, r.low AS nl, r.date AS nd,
            CASE WHEN falling THEN least(trough, r.low) ELSE trough END AS t2
          FROM k JOIN runs r ON r.run = k.run AND r.i = k.i + 1))),
    legs AS (
      SELECT k.run, CASE WHEN falling AND peak > trough AND trough > 0 THEN
          CASE WHEN len(legs) > 0 AND (peak - trough) / peak * 100 >= legs[-1].x
            THEN [{{'d': pd, 'p': peak, 'x': (peak - trough) / peak * 100}}]
            ELSE list_append(legs, {{'d': pd, 'p': peak, 'x': (peak - trough) / peak * 100}}) END
        ELSE legs END AS legs
      FROM k JOIN tops t ON t.run = k.run AND t.n = k.i)"""


def contractions() -> str:
    runs = f"""{numbered('nation', f"date <= DATE '{DECISION}'")}, runs AS (
      SELECT symbol AS run, i, date, high, low, 15.0::DOUBLE AS initial FROM numbered)"""
    return f"""{cascade(runs)}, result AS (
      SELECT run AS symbol, n - 1 AS seq, legs[n].d AS peak_date, legs[n].p AS peak, legs[n].x AS depth_pct
      FROM (SELECT run, legs, unnest(range(1, len(legs) + 1)) AS n FROM legs))"""


def footprints(thresholds: tuple[float, ...]) -> str:
    starts = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    runs = f"""{_recursive(f"WITH {o.bars('supplier')}")}, asked AS (
      SELECT symbol, date AS session, initial FROM bars, (VALUES {starts}) v(initial)),
    runs AS (
      SELECT symbol || '|' || session || '|' || initial AS run, a.symbol, session, initial, b.date, high, low,
        row_number() OVER (PARTITION BY symbol, session, initial ORDER BY b.date) AS i
      FROM asked a JOIN bars b USING (symbol) WHERE b.date > session - 455 AND b.date <= session)"""
    return f"""{cascade(runs)},
    prints AS (
      SELECT a.symbol, a.session, a.initial AS initial_pct,
        CASE WHEN ok THEN (a.session - legs[1].d) / 7.0 END AS "Base_Weeks",
        CASE WHEN ok THEN list_max(list_transform(legs, lambda g: g.x)) END AS "Deepest_Pct",
        CASE WHEN ok THEN legs[-1].x END AS "Tightest_Pct",
        CASE WHEN ok THEN len(legs) ELSE 0 END AS "Contractions",
        CASE WHEN ok THEN legs[-1].p END AS "VCP_Pivot"
      FROM asked a LEFT JOIN (
        SELECT run, legs, len(legs) BETWEEN 1 AND 6 AS few FROM legs) l
        ON l.run = a.symbol || '|' || a.session || '|' || a.initial
      CROSS JOIN LATERAL (SELECT coalesce(few AND (a.session - legs[1].d) / 7.0 BETWEEN 3 AND 65, false) AS ok)),
    labelled AS (
      SELECT *, CASE WHEN "Base_Weeks" IS NULL THEN '—' ELSE round_even("Base_Weeks", 0)::INT || 'W '
        || round_even("Deepest_Pct", 0)::INT || '/' || round_even("Tightest_Pct", 0)::INT || ' '
        || "Contractions" || 'T' END AS label FROM prints)"""


def recoveries() -> str:
    return f"""{numbered('nation', f"date <= DATE '{DECISION}'")},
    v AS (
      SELECT symbol, 1::BIGINT AS i, high AS peak, date AS pd, low AS trough,
        NULL::DATE AS od, NULL::DOUBLE AS op, NULL::DOUBLE AS ot FROM numbered WHERE i = 1
      UNION ALL
      SELECT symbol, ni, CASE WHEN longer OR done THEN nh ELSE peak END,
        CASE WHEN longer OR done THEN nd ELSE pd END,
        CASE WHEN longer OR done THEN nl ELSE t2 END,
        CASE WHEN done THEN pd END, CASE WHEN done THEN peak END, CASE WHEN done THEN t2 END
      FROM (SELECT *, NOT longer AND (peak - t2) / peak * 100 >= 1.0
            AND nh >= t2 + 0.7 * (peak - t2) AS done
        FROM (SELECT v.symbol, v.peak, v.pd, n.i AS ni, n.high AS nh, n.low AS nl, n.date AS nd,
            n.high >= peak AND (peak - trough) / peak * 100 < 1.0 AS longer,
            least(trough, n.low) AS t2
          FROM v JOIN numbered n ON n.symbol = v.symbol AND n.i = v.i + 1))),
    legs AS (
      SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS seq, od AS peak_date,
        op AS peak, ot AS trough, (op - ot) / op * 100 AS depth_pct FROM v WHERE od IS NOT NULL)"""
