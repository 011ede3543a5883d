"""Bars, coverage, the information boundary and data quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from breadthline.operators import boundary as b
from breadthline.operators import universe as u
from breadthline.plans import research as plans
from breadthline.sources import trades
from verification import oracle_base as o
from verification.inputs import DECISION
from verification.registry import register

D = o.D
BARS = "symbol, date:d, close:f, high:f, low:f, volume:f"


@register("bars", BARS, ctes=f"WITH {o.bars()}", source="bars")
def _(i):
    return i.bars()


@register("bars_with_gaps", BARS, "settled", f"WITH {o.bars('settled')}", "bars")
def _(i):
    return b.normalize_bars(i.bars())


@register("benchmark_index", "date:d, close:f", ctes=f"WITH {o.BENCH}", source="bench")
def _(i):
    return i.benchmark()


@register("universe_constituents", "Symbol, Company Name, Industry, Series",
          ctes=f"WITH {o.lines()}", source="universe")
def _(i):
    return u.check_universe(i.universe())


@register(
    "duplicate_session_symbols", "symbol, duplicate_sessions:i",
    ctes="""WITH result AS (
      SELECT CAST(l_partkey AS VARCHAR) AS symbol, count(*) AS duplicate_sessions FROM (
        SELECT l_partkey, CAST(l_shipdate AS DATE) AS date FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)""")
def _(i):
    raw = i.table("lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
    )
    return b.duplicate_symbols(raw)


@register(
    "clean_histories", "symbol, sessions:i",
    ctes="""WITH raw AS (
      SELECT CAST(l_partkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem),
    result AS (
      SELECT symbol, count(*) AS sessions FROM raw WHERE symbol NOT IN (
        SELECT symbol FROM raw GROUP BY symbol, date HAVING count(*) > 1) GROUP BY symbol)""")
def _(i):
    raw = i.table("lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
    )
    return b.reject_duplicates(raw).groupBy("symbol").agg(F.count(F.lit(1)).alias("sessions"))


@register(
    "latest_completed_sessions", "symbol, latest_session:d", "settled",
    f"""WITH {o.bars('settled')}, result AS (
      SELECT symbol, max(date) AS latest_session FROM bars
      WHERE close IS NOT NULL AND date < {D} GROUP BY symbol)""")
def _(i):
    return b.latest_completed_sessions(i.bars(), DECISION)


@register(
    "calendar_asof", "symbol, asof_session:d, asof_close:f", "settled",
    f"""WITH {o.bars('settled')}, result AS (
      SELECT symbol, max(date) AS asof_session, arg_max(close, date) AS asof_close FROM bars
      WHERE close IS NOT NULL AND date <= DATE '1998-10-04' GROUP BY symbol)""")
def _(i):
    return b.calendar_asof(i.bars(), dt.date(1998, 10, 4))


@register(
    "session_coverage", "date:d, symbols:i", "settled",
    f"""WITH {o.bars('settled')}, result AS (
      SELECT date, count(*) AS symbols FROM bars WHERE close IS NOT NULL AND date < {D}
      GROUP BY date)""")
def _(i):
    return b.session_coverage(i.bars(), DECISION)


@register(
    "information_boundary", "boundary:d, previous:d", "supplier",
    f"""WITH {o.bars('supplier')}, {o.boundary('supplier')},
      {o.boundary('supplier', 'bnd2', '(SELECT b FROM bnd)')},
      result AS (SELECT bnd.b AS boundary, bnd2.b AS previous FROM bnd, bnd2)""")
def _(i):
    day = i.boundary()
    return i.spark.range(1).select(
        F.lit(day).alias("boundary"), F.lit(i.boundary(day)).alias("previous")
    )


@register(
    "unavailable_symbols", "symbol, reason", "settled",
    f"""WITH {o.bars('settled')}, {o.boundary('settled')}, result AS (
      SELECT u."Symbol" AS symbol, CASE WHEN k.symbol IS NULL THEN 'the provider returned no history'
        WHEN k.d IS NULL THEN 'No completed market session exists before decision date'
        ELSE 'no completed session at the global boundary ' || (SELECT b FROM bnd)::VARCHAR
          || '; its latest is ' || k.d::VARCHAR END AS reason
      FROM universe u LEFT JOIN (
        SELECT symbol, max(date) FILTER (WHERE close IS NOT NULL AND date <= (SELECT b FROM bnd)) AS d
        FROM bars GROUP BY symbol) k ON k.symbol = u."Symbol"
      WHERE k.d IS NULL OR k.d <> (SELECT b FROM bnd))""")
def _(i):
    return b.unavailable(
        i.universe().withColumnRenamed("Symbol", "symbol"), i.landed_bars(), i.boundary()
    )


@register(
    "own_session_snapshot", "Symbol, Date:d, Close:f, R3M:f, R12M:f", "settled",
    f"""WITH {o.bars('settled')}, c AS (
      SELECT symbol, date, close, max(date) OVER (PARTITION BY symbol) AS t FROM bars
      WHERE close IS NOT NULL AND date < {D}),
    p AS (
      SELECT symbol, max(t) AS t, arg_max(close, date) AS c0,
        arg_max(close, date) FILTER (WHERE date <= t - INTERVAL 3 MONTH) AS c3,
        arg_max(close, date) FILTER (WHERE date <= t - INTERVAL 12 MONTH) AS c12
      FROM c GROUP BY symbol),
    result AS (
      SELECT symbol AS "Symbol", t AS "Date", c0 AS "Close",
        CASE WHEN c12 IS NOT NULL THEN c0 / c3 - 1 END AS "R3M", c0 / c12 - 1 AS "R12M" FROM p)""")
def _(i):
    return plans.own_session_research(i.bars(), DECISION)


@register(
    "session_trading", "date:d, known:i, traded:i, closed", "nation",
    f"""WITH {o.bars('nation', 'traded')}, result AS (
      SELECT date, count(volume) AS known, count(*) FILTER (WHERE volume > 0) AS traded,
        count(volume) >= 20 AND count(*) FILTER (WHERE volume > 0) / count(volume) < 0.05 AS closed
      FROM bars GROUP BY date)""")
def _(i):
    return b.session_trading(i.thinly_traded_bars())


@register(
    "bars_without_thin_sessions", "symbol, sessions:i, volume:f", "nation",
    f"""WITH {o.bars('nation', 'traded')}, thin AS (
      SELECT date FROM bars GROUP BY date
      HAVING count(*) FILTER (WHERE volume > 0) < 0.5 * count(volume)),
    result AS (
      SELECT symbol, count(*) AS sessions, sum(volume) AS volume FROM bars
      WHERE date NOT IN (SELECT date FROM thin) GROUP BY symbol)""")
def _(i):
    rows = i.thinly_traded_bars()
    thin = b.session_trading(rows).filter(F.col("traded") < 0.5 * F.col("known")).select("date")
    return b.without_sessions(rows, thin).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("volume").alias("volume")
    )


@register(
    "date_coverage", "Date:d, symbols:i, lagging, pct:f", "settled",
    f"""WITH {o.bars('settled')}, own AS (
      SELECT symbol, max(date) AS d FROM bars WHERE close IS NOT NULL AND date < {D} GROUP BY symbol),
    result AS (
      SELECT d AS "Date", count(*) AS symbols, d <> (SELECT max(d) FROM own) AS lagging,
        100.0 * count(*) / (SELECT count(*) FROM own) AS pct FROM own GROUP BY d)""")
def _(i):
    rows = b.latest_completed_sessions(i.bars(), DECISION)
    return b.date_coverage(rows.withColumnRenamed("latest_session", "Date"))


@register(
    "lagging_symbols", "Symbol, Date:d", "settled",
    f"""WITH {o.bars('settled')}, own AS (
      SELECT symbol AS "Symbol", max(date) AS "Date" FROM bars
      WHERE close IS NOT NULL AND date < {D} GROUP BY symbol),
    result AS (SELECT * FROM own WHERE "Date" <> (SELECT max("Date") FROM own))""")
def _(i):
    rows = b.latest_completed_sessions(i.bars(), DECISION)
    return b.lagging_symbols(rows.toDF("Symbol", "Date"))


@register(
    "decision_dates", "decision:d, events:i",
    ctes="""WITH shifted AS (SELECT ts + INTERVAL 330 MINUTE AS local FROM events),
    result AS (
      SELECT CAST(local AS DATE) + CASE WHEN hour(local) >= 16 THEN 1 ELSE 0 END AS decision,
        count(*) AS events FROM shifted GROUP BY 1)""")
def _(i):
    days = i.table("events").select(
        b.decision_date(F.col("ts").cast("timestamp")).alias("decision")
    )
    return days.groupBy("decision").agg(F.count(F.lit(1)).alias("events"))


@register(
    "maturing", "Symbol, Sessions_52W:i, Blocked_By, Sessions_To_Go:i, Matures_Around:d", "settled",
    f"""{o.snapshot('settled')}, h AS (
      SELECT symbol, min(date) AS f,
        count(*) FILTER (WHERE date > (SELECT b FROM bnd) - 364) AS s
      FROM c GROUP BY symbol),
    days AS (SELECT unnest(generate_series((SELECT b FROM bnd), (SELECT b FROM bnd) + 800,
      INTERVAL 1 DAY))::DATE AS day),
    work AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM days
      WHERE isodow(day) < 6 AND day > (SELECT b FROM bnd)),
    result AS (
      SELECT r."Symbol", h.s AS "Sessions_52W",
        CASE WHEN h.f > (SELECT b FROM bnd) - 364 THEN 'history' ELSE 'sessions' END AS "Blocked_By",
        CASE WHEN h.f > (SELECT b FROM bnd) - 364
          THEN (SELECT count(*) FROM days WHERE isodow(day) < 6 AND day <= h.f + 364) - 1
          ELSE 200 - h.s END AS "Sessions_To_Go",
        CASE WHEN h.f > (SELECT b FROM bnd) - 364 THEN h.f + 364
          ELSE (SELECT day FROM work WHERE k = 200 - h.s) END AS "Matures_Around"
      FROM research r JOIN h ON h.symbol = r."Symbol" WHERE r."High_52W" IS NULL)""")
def _(i):
    day, bars = i.boundary(), i.landed_bars()
    rows = plans.measured_rows(bars, day)
    return b.maturing(rows, bars, day)


@register(
    "session_calendar", "date:d", "settled",
    f"WITH {o.bars('settled')}, result AS (SELECT DISTINCT date FROM bars WHERE close IS NOT NULL)")
def _(i):
    return u.session_calendar(i.bars())


@register(
    "liquidity_admission", "symbol, first_session:d, traded:i, possible:i, admitted", "nation",
    f"""WITH {o.bars()}, cal AS (SELECT DISTINCT date FROM bars),
    recent AS (SELECT date FROM cal ORDER BY date DESC LIMIT 60),
    f AS (SELECT symbol, min(date) AS first_session FROM bars GROUP BY symbol),
    t AS (SELECT symbol, count(*) AS traded FROM bars JOIN recent USING (date) GROUP BY symbol),
    p AS (SELECT symbol, count(*) AS possible FROM f JOIN recent ON recent.date >= f.first_session
      GROUP BY symbol),
    result AS (
      SELECT f.symbol, f.first_session, coalesce(traded, 0) AS traded, coalesce(possible, 0) AS possible,
        coalesce(possible, 0) >= 10 AND coalesce(traded, 0) >= 0.9 * coalesce(possible, 0) AS admitted
      FROM f LEFT JOIN t USING (symbol) LEFT JOIN p USING (symbol))""")
def _(i):
    return u.liquidity(i.bars())


CANDIDATES = """raw AS (
  SELECT CASE WHEN s_acctbal < 0 THEN 'BSE:' ELSE 'nse:' END || replace(s_name, '#', '_') AS company_id,
    s_name || ' Limited' AS name, n_name AS industry
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
candidates AS (
  SELECT replace(upper(trim(substr(company_id, 5))), '_', '-') AS "Symbol",
    regexp_replace(trim(name), '\\s+Limited$', ' Ltd') AS "Company Name", industry AS "Industry"
  FROM raw WHERE upper(company_id) LIKE 'NSE:%')"""


def _candidate_list(i):
    exchange = F.when(F.col("s_acctbal") < 0, "BSE:").otherwise("nse:")
    return i.suppliers().select(
        F.concat(exchange, F.translate("s_name", "#", "_")).alias("company_id"),
        F.concat("s_name", F.lit(" Limited")).alias("name"),
        F.col("n_name").alias("industry"),
    )


@register("candidates", "Symbol, Company Name, Industry", ctes=f"WITH {CANDIDATES}",
          source="candidates")
def _(i):
    return u.candidates(_candidate_list(i))


EXISTING = """existing AS (
  SELECT upper(replace(s_name, '#', '-')) AS "Symbol", s_name AS "Company Name",
    n_name AS "Industry", 'EQ' AS "Series"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 5000)"""


def _existing(i):
    return i.suppliers().filter(F.col("s_acctbal") < 5000).select(
        F.upper(F.translate("s_name", "#", "-")).alias("Symbol"),
        F.col("s_name").alias("Company Name"), F.col("n_name").alias("Industry"),
        F.lit("EQ").alias("Series"),
    )


@register(
    "universe_merge", "Symbol, Company Name, Industry, Series",
    ctes=f"""WITH {CANDIDATES}, {EXISTING}, result AS (
      SELECT * FROM existing UNION ALL
      SELECT *, 'EQ' FROM candidates WHERE "Symbol" NOT IN (SELECT "Symbol" FROM existing))""")
def _(i):
    sectors = [r[0] for r in i.table("nation").select("n_name").collect()]  # 25 rows by definition
    return u.merge(_existing(i), u.candidates(_candidate_list(i)), allow_sectors=sectors)


RESTRICTED = f"""WITH {CANDIDATES}, {EXISTING}, result AS (
  SELECT *, "Symbol" IN (SELECT "Symbol" FROM candidates) AS listed FROM existing)"""


@register("universe_restricted", "Symbol, Company Name, Industry, Series, listed", ctes=RESTRICTED)
def _(i):
    kept, gone = u.restrict(_existing(i), u.listed_symbols(_candidate_list(i)))
    return kept.withColumn("listed", F.lit(True)).unionByName(gone.withColumn("listed", F.lit(False)))


@register("universe_board_removed", "Symbol, Company Name, Industry, Series, listed", ctes=RESTRICTED)
def _(i):
    kept, gone = u.remove(_existing(i), u.listed_symbols(_candidate_list(i)))
    return kept.withColumn("listed", F.lit(False)).unionByName(gone.withColumn("listed", F.lit(True)))


@register(
    "provider_symbols", "symbol, ticker",
    ctes="""WITH result AS (
      SELECT s_name AS symbol, s_name || '.NS' AS ticker FROM supplier UNION ALL
      SELECT n_name || '.ns', n_name || '.ns' FROM nation)""")
def _(i):
    names = i.table("supplier").select(F.col("s_name").alias("symbol")).unionByName(
        i.table("nation").select(F.concat("n_name", F.lit(".ns")).alias("symbol"))
    )
    return names.withColumn("ticker", u.provider_symbol("symbol"))


@register(
    "wide_response_unpivot", "symbol, date:d, close:f, volume:f",
    ctes="""WITH raw AS (
      SELECT r_name AS symbol, CAST(l_shipdate AS DATE) AS date,
        sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
    result AS (SELECT * FROM raw)""")
def _(i):
    from breadthline.sources.readers import long_bars

    bars = i.bars_of("r_name")
    regions = [r[0] for r in i.table("region").select("r_name").collect()]  # 5 rows by definition
    wide = bars.groupBy(F.col("date").alias("Date")).pivot("symbol", regions).agg(
        F.first("close").alias("Close"), F.first("volume").alias("Volume")
    )
    renamed = wide.toDF(*[
        "Date" if n == "Date" else "|".join(n.rsplit("_", 1)) for n in wide.columns
    ])
    return long_bars(renamed)
