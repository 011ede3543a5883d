"""A variant of the bars whose symbols take every branch of the rules.

The noise comes from the trade lines, the course of each symbol from a table of shapes. Lines are
dealt to symbols by part and folded into 480 days, so that every symbol trades on nearly every day.
A day's price is the symbol's level times the day's price over its usual one, damped; its volume is
what was traded times the shape's weights. Both engines compute levels with the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = 480
#: Days at which a shape states its level, counted from the first.
GRID = (0, 60, 120, 240, 320, 380, 420, 450, 465, 479)
#: On these days nobody trades, though prices are there.
IDLE = (200, 333)

# name: levels on the grid, then what is not usual:
#   up, down   weights of the volume on days after an even and an odd one (odd days are the lower ones)
#   surge      weight of the last two days' volume
#   dry        weight of the last ten days' volume
#   wick       how far highs reach above the rest
#   quiet      noise that halves over the last five blocks of ten days
#   halved     first day after a split in two
#   since      first day with bars, until the first without
SHAPES: tuple[tuple[str, tuple[float, ...], dict[str, float]], ...] = (
    ("breakout confirmed", (100, 100, 100, 112, 126, 140, 149, 156, 159, 163), {"up": 4, "surge": 5}),
    ("breakout", (100, 100, 100, 111, 125, 139, 148, 155, 158, 162), {"surge": 5, "down": 1.1}),
    ("leader", (100, 100, 100, 110, 124, 138, 147, 154, 157, 161), {"up": 2}),
    ("extended", (100, 100, 100, 100, 105, 115, 130, 150, 165, 185), {}),
    ("contracting", (100, 100, 100, 118, 142, 152, 154, 155, 155.5, 156), {"dry": 0.3, "quiet": 1}),
    ("line leads", (100, 100, 100, 109, 122, 136, 146, 153, 156, 160), {"wick": 0.08}),
    ("basing leader", (30, 30, 30, 60, 120, 160, 170, 165, 155, 140), {}),
    ("distributed", (100, 100, 102, 110, 118, 124, 128, 131, 132, 134), {"down": 6}),
    ("holding", (100, 100, 104, 110, 116, 121, 124, 127, 128, 130), {}),
    ("second breakout", (100, 100, 103, 109, 115, 120, 123, 126, 127, 130), {"surge": 5, "up": 4}),
    ("slow", (100, 100, 100, 100, 100, 100.5, 101, 101, 101.5, 102), {}),
    ("topping", (80, 80, 90, 140, 132, 112, 100, 102, 110, 127), {}),
    ("topping weak", (200, 190, 175, 150, 125, 104, 93, 90, 93, 111), {}),
    ("topping sold", (90, 90, 95, 138, 130, 112, 100, 101, 108, 124), {"down": 6}),
    ("basing", (70, 70, 80, 95, 115, 125, 121, 117, 115.5, 115), {"quiet": 1, "dry": 0.4}),
    ("basing weak", (150, 140, 130, 86, 94, 104, 104, 101, 98, 95), {}),
    ("halved", (200, 200, 203, 210, 216, 222, 224, 228, 230, 232), {"halved": 350}),
    ("young", (50, 50, 50, 50, 50, 50, 55, 58, 60, 62), {"since": 400}),
    ("gone", (90, 90, 90, 90, 90, 90, 90, 90, 90, 90), {"until": 470}),
) + tuple(
    (f"falling {n}", tuple(150 - (1 + 0.25 * n) * step for step in range(10)), {}) for n in range(14))
USUAL = {"up": 1.0, "down": 1.0, "surge": 1.0, "dry": 1.0, "wick": 0.0, "quiet": 0.0, "halved": 0.0, "since": 0.0,
         "until": DAYS}
COLUMNS = ("k", *[f"p{n}" for n in range(len(GRID))], *USUAL)
COUNT = len(SHAPES)

FOLD = f"CAST((datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % {DAYS}) AS INT)"
LEVEL = "p0 + " + " + ".join(
    f"(p{n + 1} - p{n}) * least(1e0, greatest(0e0, (t - {GRID[n]}) / {GRID[n + 1] - GRID[n]}e0))"
    for n in range(len(GRID) - 1))
# The last fifty days come in five blocks; `quiet` halves the noise from each to the next.
NOISE = (f"2e-2 * CASE WHEN quiet > 0 AND t >= {DAYS - 50} "
         f"THEN power(5e-1, floor((t - {DAYS - 50}) / 1e1)) ELSE 5e-1 END")
WEIGHT = (f"CASE WHEN t IN ({', '.join(map(str, IDLE))}) THEN 0e0 ELSE "
          f"(CASE WHEN t % 2 = 0 THEN up ELSE down END) * (CASE WHEN t >= {DAYS - 2} THEN surge "
          f"ELSE 1e0 END) * (CASE WHEN t >= {DAYS - 10} THEN dry ELSE 1e0 END) END")
# Prices of lines differ a thousandfold: p / (p + 1) keeps their order and lies between 0 and 1.
PRICES = {
    "close": "lvl * (1e0 + noise * (x / (x + 1e0) - 5e-1))",
    "high": "lvl * (1e0 + noise * (hi / (hi + 1e0) - 5e-1) + wick)",
    "low": "lvl * (1e0 + noise * (lo / (lo + 1e0) - 5e-1))",
    "volume": "q * weight * CASE WHEN k % 3 = 0 THEN 8e3 ELSE 1e0 END",
}
# Odd days lie a little lower, which makes them the days of falling prices.
SWING = "(1e0 - 4e-3 * (t % 2)) * CASE WHEN halved > 0 AND t >= halved THEN 5e-1 ELSE 1e0 END"


def _rows() -> list[tuple]:
    return [(k, *map(float, levels), *[float(({**USUAL, **odd})[name]) for name in USUAL])
            for k, (_, levels, odd) in enumerate(SHAPES)]


def sql() -> str:
    """CTEs `universe` and `bars`."""
    values = ", ".join(
        "(" + ", ".join(str(v) if n == 0 else f"{v!r}::DOUBLE" for n, v in enumerate(row)) + ")"
        for row in _rows())
    return f"""
shapes({', '.join(COLUMNS)}) AS (VALUES {values}),
universe AS (
  SELECT 'SHAPE_' || lpad(k::VARCHAR, 2, '0') AS "Symbol", 'Company ' || k AS "Company Name",
    'SECTOR ' || (k % 4) AS "Industry", 'EQ' AS "Series" FROM shapes),
folded AS (
  SELECT l_partkey % {COUNT} AS k, {FOLD} AS t, sum(l_extendedprice) / sum(l_quantity) / 1500e0 AS x,
    max(l_extendedprice / l_quantity) / 1500e0 AS hi, min(l_extendedprice / l_quantity) / 1500e0 AS lo,
    sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
levelled AS (
  SELECT *, ({LEVEL}) * ({SWING}) AS lvl, {NOISE} AS noise, {WEIGHT} AS weight
  FROM folded JOIN shapes USING (k) WHERE t >= since AND t < "until"),
bars AS (
  SELECT 'SHAPE_' || lpad(k::VARCHAR, 2, '0') AS symbol, DATE '1996-01-01' + t AS date,
    {', '.join(f'{e} AS {n}' for n, e in PRICES.items())} FROM levelled)"""


def bench_sql() -> str:
    return f"""
bench AS (
  SELECT DATE '1996-01-01' + {FOLD} AS date,
    1000e0 + sum(l_extendedprice) / sum(l_quantity) / 1500e0 AS close FROM lineitem GROUP BY 1)"""


def _folded_day():
    return F.pmod(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")),
                  F.lit(DAYS)).cast("int")


def bars(lines: DataFrame) -> DataFrame:
    spark: SparkSession = lines.sparkSession
    price = F.col("l_extendedprice") / F.col("l_quantity")
    folded = lines.groupBy((F.col("l_partkey") % COUNT).alias("k"), _folded_day().alias("t")).agg(
        (F.sum("l_extendedprice") / F.sum("l_quantity") / 1500.0).alias("x"),
        (F.max(price) / 1500.0).alias("hi"), (F.min(price) / 1500.0).alias("lo"),
        F.sum("l_quantity").alias("q"))
    kinds = ", ".join(f"`{name}` {'long' if name == 'k' else 'double'}" for name in COLUMNS)
    # One row for each shape of the table above.
    rows = folded.join(F.broadcast(spark.createDataFrame(_rows(), kinds)), "k").filter(
        (F.col("t") >= F.col("since")) & (F.col("t") < F.col("until")))
    rows = rows.select("*", F.expr(f"({LEVEL}) * ({SWING})").alias("lvl"),
                       F.expr(NOISE).alias("noise"), F.expr(WEIGHT).alias("weight"))
    return rows.select(
        F.concat(F.lit("SHAPE_"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("symbol"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("t")).alias("date"),
        *[F.expr(e).alias(n) for n, e in PRICES.items()])


def benchmark(lines: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("1996-01-01").cast("date"), _folded_day())
    return lines.groupBy(day.alias("date")).agg(
        (F.lit(1000.0) + F.sum("l_extendedprice") / F.sum("l_quantity") / 1500.0).alias("close"))


def universe(spark: SparkSession) -> DataFrame:
    return spark.range(COUNT).select(
        F.concat(F.lit("SHAPE_"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("Symbol"),
        F.concat(F.lit("Company "), F.col("id").cast("string")).alias("Company Name"),
        F.concat(F.lit("SECTOR "), (F.col("id") % 4).cast("string")).alias("Industry"),
        F.lit("EQ").alias("Series"))
