"""Queries of scripts by data sets: routed, evaluated in one plan, stored and extended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import matrix
from tickloom.operators import script as scripts_of
from tickloom.plans.evaluation_queries import CCI, MACD, ROC, RSI, signal_sql
from tickloom.plans.registry import register
from tickloom.plans.series_queries import FLOW, TP, bars
from tickloom.session import shared_folder

#: What the scripts say, by the remainder of their nation's key, and where they are routed by it.
BODIES = {
    0: ("x = ta.rsi(close, 14)\n", "rsi"),
    1: ("fastLen = input.int(12)\nslowLen = input.int(26)\n", "macd"),
    2: ("length = input.int(20)\nx = ta.cci(close, length)\n", "cci"),
    3: ("x = ta.mfi(hlc3, 14)\n", "mfi"),
    4: ("plot(close)\n", "roc"),
}


def scripts(spark, sf_dir: str) -> DataFrame:
    """One script for each nation."""
    kind = F.col("n_nationkey") % 5
    body = F.coalesce(*[F.when(kind == k, F.lit(text)) for k, (text, _) in BODIES.items()])
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("script"), F.concat(F.lit('//@version=5\nindicator("x")\n'), body).alias("body"), "n_nationkey")


def counted(spark, sf_dir: str) -> DataFrame:
    """Signals of every script on every symbol's 4-hour bars, counted."""
    b = bars(spark, sf_dir)
    return shown(matrix.measured(b, matrix.combinations(scripts(spark, sf_dir), b), matrix.signal_counts))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("script", "symbol", "kind", "length", "bars", "buys", "sells", F.round("mean_signal", 3).alias("mean_signal"))


STORED = "script string, symbol string, interval string, kind string, length int, bars long, buys long, sells long, mean_signal double"


def stored(spark, sf_dir: str) -> DataFrame:
    """The same rows from a store that one run fills with some scripts on some symbols, and the next
    with what is absent."""
    b, every = bars(spark, sf_dir), scripts(spark, sf_dir)
    store = matrix.ResultStore(spark, f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}", STORED, ["script", *matrix.KEY])
    matrix.extend(store, b, every.where("n_nationkey < 12"), matrix.signal_counts, b.where("symbol < 'm'"))
    return shown(matrix.extend(store, b, every, matrix.signal_counts))


_BY_KIND = {
    "rsi": (14, signal_sql(RSI, "rsi - 50", "rsi", recursive_=True)),
    "macd": (0, signal_sql(MACD, "line - signal", "macd", recursive_=True)),
    "cci": (20, signal_sql(TP, CCI, "u")),
    "mfi": (14, signal_sql(FLOW, "CASE WHEN n = 14 THEN 100 - 100 / (1 + CASE WHEN neg = 0 THEN 100 ELSE pos / neg END) END - 50", "v")),
    "roc": (14, signal_sql(ROC, "x", "t")),
}
_COUNTS = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, {length} AS length, symbol, count(*) AS bars, count_if(buy_signal) AS buys, count_if(sell_signal) AS sells, avg(combined_signal) AS mean_signal FROM ({statement}) GROUP BY symbol"
    for kind, (length, statement) in _BY_KIND.items()
)
_ROUTE = " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in BODIES.items())
COUNTED = f"""
SELECT n_name AS script, symbol, kind, length, bars, CAST(buys AS BIGINT) AS buys, CAST(sells AS BIGINT) AS sells, round(mean_signal, 3) AS mean_signal
FROM nation JOIN ({_COUNTS}) c ON c.kind = CASE n_nationkey % 5 {_ROUTE} END
"""
register("j04_script_matrix", counted, COUNTED)
register("o13_j05_stored_matrix", stored, COUNTED)


def plotting(spark, sf_dir: str) -> DataFrame:
    """Scripts with one input or two, that plot a series, a number, or nothing."""
    key = F.col("n_nationkey")
    body = F.concat(
        F.lit('//@version=5\nindicator("x")\nfast = input.int(3)\n'), F.when(key % 2 == 0, "slow = input.int(9)\n").otherwise(""),
        F.when(key % 3 == 0, "plot(ta.sma(close, fast), color=red)\nplot(open)\n").when(key % 3 == 1, "  plot( 50 , color=red)\n").otherwise("x = fast\n"),
    )
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("script"), body.alias("body"))


_ADDED = """'smooth_len = input.int(5, title="Smooth Len", minval=1, maxval=50)' || chr(10) || 'scale_mult = input.float(1.0, title="Scale Mult", minval=0.1, maxval=3.0)' || chr(10)"""
_LINES = "'smoothed = ta.sma(' || {} || ', smooth_len)' || chr(10) || 'scaled = smoothed * scale_mult' || chr(10)"
_HEAD = "'//@version=5' || chr(10) || 'indicator(\"x\")' || chr(10)"
_FAST = "'fast = input.int(3)' || chr(10)"
register(
    "l06_widened_scripts",
    lambda s, d: scripts_of.widened(plotting(s, d)),
    f"""SELECT n_name AS script, CASE WHEN n_nationkey % 2 = 0 THEN {_HEAD} || {_FAST} || 'slow = input.int(9)' || chr(10) ||
  CASE n_nationkey % 3 WHEN 0 THEN 'plot(ta.sma(close, fast), color=red)' || chr(10) || 'plot(open)' || chr(10) WHEN 1 THEN '  plot( 50 , color=red)' || chr(10) ELSE 'x = fast' || chr(10) END
ELSE CASE n_nationkey % 3
  WHEN 0 THEN {_HEAD} || {_ADDED} || {_FAST} || {_LINES.format("'ta.sma(close'")} || 'plot(scaled, fast), color=red)' || chr(10) || 'plot(open)' || chr(10)
  WHEN 1 THEN {_HEAD} || {_ADDED} || {_FAST} || {_LINES.format("'close'")} || '  plot( scaled, color=red)' || chr(10)
  ELSE {_LINES.format("'close'")} || 'plot(scaled, "Signal")' || chr(10) || {_HEAD} || {_ADDED} || {_FAST} || 'x = fast' || chr(10) END
END AS body FROM nation""",
)


def ensembles(spark, sf_dir: str) -> DataFrame:
    """A script of the three nations of each region that come first by their key."""
    key = F.col("n_nationkey")
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    kind = F.when(key % 2 == 0, "rsi").otherwise("roc")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("region"), rank.alias("rank"), F.col("n_name").alias("name"), (key / 8.0).alias("score"), kind.alias("kind"), (key + 2).cast("int").alias("length"))
    return scripts_of.ensemble_scripts(rows.where("rank <= 3"), ["region"])


_K = "CAST(rank AS VARCHAR)"
register(
    "l07_ensemble_scripts",
    ensembles,
    f"""WITH m AS (SELECT n_regionkey AS region, n_nationkey AS k, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation QUALIFY rank <= 3)
SELECT region, '//@version=6' || chr(10) || '// Ensemble by majority of' || chr(10) || string_agg('//   ' || {_K} || '. ' || name || ': ' || printf('%.4f', k / 8.0::DOUBLE), chr(10) ORDER BY rank) || chr(10) || 'indicator("Ensemble", overlay=false)' || chr(10) ||
string_agg('m' || {_K} || '_on = input.bool(true, "' || name || '")' || chr(10) || 'm' || {_K} || '_length = input.int(' || CAST(k + 2 AS VARCHAR) || ', "Length", minval=1)', chr(10) ORDER BY rank) || chr(10) ||
string_agg('m' || {_K} || ' = ' || CASE WHEN k % 2 = 0 THEN 'ta.rsi(close, m' || {_K} || '_length) - 50' ELSE 'ta.roc(close, m' || {_K} || '_length)' END || chr(10) ||
  'm' || {_K} || '_buy = m' || {_K} || '_on and ta.crossover(m' || {_K} || ', 0)' || chr(10) || 'm' || {_K} || '_sell = m' || {_K} || '_on and ta.crossunder(m' || {_K} || ', 0)', chr(10) ORDER BY rank) || chr(10) ||
'voters = math.max(' || string_agg('(m' || {_K} || '_on ? 1 : 0)', ' + ' ORDER BY rank) || ', 1)' || chr(10) || 'buys = (' || string_agg('(m' || {_K} || '_buy ? 1 : 0)', ' + ' ORDER BY rank) || ') / voters' || chr(10) ||
'sells = (' || string_agg('(m' || {_K} || '_sell ? 1 : 0)', ' + ' ORDER BY rank) || ') / voters' || chr(10) || 'buy = buys > 0.5' || chr(10) || 'sell = sells > 0.5' || chr(10) || 'plot(buys - sells, "Strength")' || chr(10) ||
'plotshape(buy, "Buy")' || chr(10) || 'plotshape(sell, "Sell")' || chr(10) || 'alertcondition(buy, "Buy")' || chr(10) || 'alertcondition(sell, "Sell")' || chr(10) AS body FROM m GROUP BY region""",
)
