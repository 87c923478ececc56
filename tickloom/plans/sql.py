"""Pieces of DuckDB SQL shared by the oracle statements."""

BARS = """
bars AS (
  SELECT event_type AS symbol, '4h' AS "interval", time_bucket(INTERVAL '4 hours', ts) AS "timestamp",
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY "timestamp") - 1 AS bar_index FROM bars
)"""
O = 'PARTITION BY symbol, "interval" ORDER BY "timestamp"'


def rows(n: int) -> str:
    return f"({O} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


CUM = f"({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
LAG = f"({O})"


def over_bars(select: str, ctes: str = "", source: str = "b", where: str = "") -> str:
    """A statement over the 4-hour bars; ctes may add steps after b."""
    more = f", {ctes}" if ctes else ""
    return f"WITH {BARS}{more} SELECT symbol, bar_index, {select} FROM {source} {where}"


def sma(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN avg({x}) OVER {rows(n)} END"


def stdev(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN stddev_pop({x}) OVER {rows(n)} END"
