"""Queries of scans over chunks, on the daily bars of the suppliers, and their SQL: exponential means
in closed form, as sums of weighted values so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import scan
from tickloom.plans.registry import register
from tickloom.sources import bars as source

#: Bars of a chunk here; small, so that a series has several chunks.
CHUNK = 1024


def daily(spark, sf_dir: str, *prices: str) -> DataFrame:
    """The bars with the prices that are scanned: a scan carries all that it is given."""
    return source.lineitem_bars(spark, sf_dir).select(*source.KEY, "timestamp", *prices)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", "timestamp", *[F.round(c, 3).alias(c) for c in columns])


_SERIES = 'PARTITION BY symbol ORDER BY "timestamp"'
DAILY = f"""
ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS "timestamp", l_extendedprice / l_quantity AS p, l_quantity AS v,
         {{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity}} AS at_
  FROM lineitem
), bars AS (
  SELECT symbol, "timestamp", arg_min(p, at_) AS open, max(p) AS high, min(p) AS low, arg_max(p, at_) AS close, sum(v) AS volume
  FROM ticks GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER ({_SERIES}) - 1 AS i, coalesce(lag(close) OVER ({_SERIES}), close) AS was FROM bars
)"""


def mean_sql(x: str, alpha: str, n: int, first: int = 0) -> str:
    """Exponential mean of x from bar `first` on, without gaps: the first value weighs whole, the k-th
    after it alpha, all by (1 - alpha) to the power of their age."""
    q = f"(1 - {alpha})"
    weight = f"CASE WHEN i = {first} THEN {x} WHEN i > {first} THEN {alpha} * {x} * pow({q}, {first} - i) ELSE 0 END"
    return f"CASE WHEN i >= {first + n - 1} THEN pow({q}, i - {first}) * sum({weight}) OVER ({_SERIES} ROWS UNBOUNDED PRECEDING) END"


def ema(n: int) -> str:
    return f"(2.0::DOUBLE / {n + 1})"


def rma(n: int) -> str:
    return f"(1.0::DOUBLE / {n})"


def over_daily(steps: list[str], *columns: str) -> str:
    """A statement over the daily bars; steps are CTEs after b, the last is read."""
    last = steps[-1].split(" AS ")[0] if steps else "b"
    found = ", ".join(f"round({x}, 3) AS {name}" for name, x in (c.split(" := ") for c in columns))
    return f"WITH {', '.join([DAILY, *steps])} SELECT symbol, \"timestamp\", {found} FROM {last}"


register(
    "f01_f02_chunked_averages",
    lambda s, d: shown(scan.smoothed(daily(s, d, "close", "volume"), CHUNK, ema=("close", "ema", 12), rma=("volume", "rma", 14)), "ema", "rma"),
    over_daily([], f"ema := {mean_sql('close', ema(12), 12)}", f"rma := {mean_sql('volume', rma(14), 14)}"),
)
register(
    "f03_chunked_range",
    lambda s, d: shown(scan.with_range(daily(s, d, "high", "low", "close"), 14, chunk_bars=CHUNK), "atr"),
    over_daily(["t AS (SELECT *, greatest(high - low, abs(high - was), abs(low - was)) AS tr FROM b)"], f"atr := {mean_sql('tr', rma(14), 14)}"),
)
_MOVES = "t AS (SELECT *, greatest(close - was, 0) AS up, greatest(was - close, 0) AS down FROM b)"
_MEANS = f"m AS (SELECT *, {mean_sql('up', rma(14), 14)} AS gain, {mean_sql('down', rma(14), 14)} AS loss FROM t)"
register(
    "f04_chunked_strength",
    lambda s, d: shown(scan.with_strength(daily(s, d, "close"), 14, chunk_bars=CHUNK), "rsi"),
    over_daily([_MOVES, _MEANS], "rsi := CASE WHEN gain IS NOT NULL THEN 100 - 100 / (1 + CASE WHEN loss = 0 THEN 100 ELSE gain / loss END) END"),
)
_LINE = f"t AS (SELECT *, {mean_sql('close', ema(12), 12)} - {mean_sql('close', ema(26), 26)} AS line FROM b)"
_SIGNAL = f"m AS (SELECT *, {mean_sql('line', ema(9), 9, 25)} AS signal FROM t)"
register(
    "f05_chunked_macd",
    lambda s, d: shown(scan.with_macd(daily(s, d, "close"), chunk_bars=CHUNK), "line", "signal", "histogram"),
    over_daily([_LINE, _SIGNAL], "line := line", "signal := signal", "histogram := line - signal"),
)
