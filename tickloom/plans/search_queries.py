"""Queries of sources, scripts, ensembles, result tables and parameter search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import ensemble, script, search
from tickloom.operators import results as result_tables
from tickloom.plans import sql
from tickloom.plans.evaluation_queries import BASE, HORIZONS, ROLL
from tickloom.plans.registry import register
from tickloom.plans.series_queries import bars
from tickloom.plans.sql import BARS, LAG
from tickloom.sources import bars as source

KEY = ["symbol", "interval", "timestamp"]


def feed(spark, sf_dir: str) -> DataFrame:
    """Events as feed rows: text fields, and milliseconds cut to the hour, so that times repeat."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = (F.unix_millis(F.date_trunc("hour", F.col("ts")).cast("timestamp"))).alias("open_time")
    return rows.select("event_id", F.col("event_type"), hour, *[F.col("value").cast("string").alias(c) for c in source.PRICES])


def arrivals(spark, sf_dir: str) -> DataFrame:
    keyed = source.project_feed(feed(spark, sf_dir), F.col("event_type"), F.lit("1h"), "event_id")
    return source.first_arrivals(keyed, "event_id").select("symbol", "timestamp", "event_id", F.round("close", 6).alias("close"))


def results(spark, sf_dir: str) -> DataFrame:
    """A table of scores: one row for each supplier (the script) and the remainder of its nation (the symbol)."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(
        F.col("s_name").alias("name"), (F.col("s_nationkey") % 3).cast("string").alias("symbol"), F.lit("1d").alias("interval"),
        F.lit(None).cast("double").alias("objective_best"), (F.col("s_acctbal") / 10000).alias("mcc"), F.lit(0.5).alias("roc_auc"),
    )


def scripts(spark, sf_dir: str) -> DataFrame:
    """One script for each nation, with inputs that depend on its key."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey")
    body = F.concat(
        F.lit('//@version=5\nindicator("'), F.col("n_name"), F.lit('")\nfastLen = input.int('), (key + 2).cast("string"), F.lit(', title="Fast", minval=1, maxval=40)\n'),
        F.when(key % 2 == 0, F.lit("slowLen = input.int(26, minval=20, maxval=60, step=5)\n")).otherwise(F.lit("")),
        F.lit("showLabels = input.bool(true)\n// old = input.int(3)\n"), F.when(key % 3 == 0, F.lit("hline(70)\nhline(30)\n")).otherwise(F.lit("")),
    )
    return rows.select(F.col("n_name").alias("script"), body.alias("body"))


def trial_means(spark, sf_dir: str) -> DataFrame:
    """Mean distance of close from its average of each trial's length: one row per trial and symbol."""
    trials = search.grid(spark, {"length": (5.0, 20.0, 5.0)}).withColumn("trial_id", F.col("length").cast("long"))
    rows = search.fan_out(bars(spark, sf_dir), trials)
    mean = F.lit(None).cast("double")
    for n in (5, 10, 15, 20):  # the lengths of the grid
        mean = F.when(F.col("trial_id") == n, series.sma(F.col("close"), n)).otherwise(mean)
    rows = rows.withColumn("mean", mean)
    return rows.groupBy("trial_id", "symbol").agg(F.round(F.avg(F.col("close") - F.col("mean")), 6).alias("distance"), F.count("mean").alias("n"))


def matrix_todo(spark, sf_dir: str) -> DataFrame:
    """Combinations of script and symbol that no stored result covers."""
    done = results(spark, sf_dir).select(F.col("symbol"), F.lit("1d").alias("interval")).distinct()
    wanted = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("symbol")).withColumn("interval", F.explode(F.array(F.lit("1d"), F.lit("4h"))))
    return wanted.join(done, ["symbol", "interval"], "left_anti")


register("s05_s06_first_arrivals", arrivals, """SELECT event_type AS symbol, date_trunc('hour', ts) AS "timestamp", min(event_id) AS event_id, round(arg_min(value, event_id), 6) AS close FROM events GROUP BY ALL""")
register("s08_s09_datasets", lambda s, d: source.datasets(s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.regexp_replace("n_name", "[^A-Z0-9]", ""), F.when(F.col("n_nationkey") % 4 == 0, "-bad").otherwise("_4h"), F.lit(".csv")).alias("file")), "file"),
         """SELECT DISTINCT regexp_replace(n_name, '[^A-Z0-9]', '', 'g') AS symbol, '4h' AS "interval" FROM nation WHERE n_nationkey % 4 <> 0""")  # fmt: skip
register("s12_symbols", lambda s, d: s.read.parquet(f"{d}/customer.parquet").groupBy(source.symbol_name(F.col("c_mktsegment")).alias("symbol")).count().withColumnRenamed("count", "n"),
         "SELECT upper(trim(c_mktsegment)) || 'USDT' AS symbol, count(*) AS n FROM customer GROUP BY ALL")
register("p03_selected_bars", lambda s, d: source.only(bars(s, d), ["click", "view", "purchase"], ["4h"]).select("symbol", "bar_index", F.round("close", 6).alias("close")),
         f"WITH {BARS} SELECT symbol, bar_index, round(close, 6) AS close FROM b WHERE symbol IN ('click', 'view', 'purchase')")
register("p04_p05_eligible_scripts", lambda s, d: script.eligible(script.parameters(scripts(s, d))), "SELECT n_name AS script, 2::BIGINT AS n_params FROM nation WHERE n_nationkey % 2 = 0")
register("s15_script_parameters", lambda s, d: script.parameters(scripts(s, d)).where("kind = 'int'").select("script", "name", "title", "default_value", "min_value", "max_value", "step"),
         """SELECT n_name AS script, 'fastLen' AS name, 'Fast' AS title, (n_nationkey + 2)::DOUBLE AS default_value, 1::DOUBLE AS min_value, 40::DOUBLE AS max_value, 1::DOUBLE AS step FROM nation
UNION ALL SELECT n_name, 'slowLen', 'slowLen', 26, 20, 60, 5 FROM nation WHERE n_nationkey % 2 = 0""")  # fmt: skip
register("s15_script_signals", lambda s, d: script.signals(scripts(s, d)),
         "SELECT n_name AS script, 5 AS version, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END AS n_levels, CASE WHEN n_nationkey % 3 = 0 THEN 'threshold' ELSE 'directional' END AS signal_type FROM nation")
register("search_space_size", lambda s, d: script.space_size(script.optimizable(script.parameters(scripts(s, d)))), "SELECT n_name AS script, (40 * CASE WHEN n_nationkey % 2 = 0 THEN 9 ELSE 1 END)::BIGINT AS space FROM nation")
register("j03_trial_fan_out", trial_means,
         f"WITH {BARS}" + ", t AS (" + " UNION ALL ".join(f"SELECT {n}::BIGINT AS trial_id, symbol, close, {sql.sma('close', n)} AS mean FROM b" for n in (5, 10, 15, 20)) + ") SELECT trial_id, symbol, round(avg(close - mean), 6) AS distance, count(mean) AS n FROM t GROUP BY ALL")
register("j05_matrix_todo", matrix_todo, """SELECT CAST(n_nationkey AS VARCHAR) AS symbol, i AS "interval" FROM nation, (VALUES ('1d'), ('4h')) v(i) WHERE NOT (i = '1d' AND n_nationkey IN (SELECT s_nationkey % 3 FROM supplier))""")
register("ensemble_pool", lambda s, d: ensemble.pool(results(s, d), 3, 0.1).select("name", "symbol", "rank", F.col("members").cast("long").alias("members"), F.round("score", 6).alias("score")),
         """WITH r AS (SELECT s_name AS name, CAST(s_nationkey % 3 AS VARCHAR) AS symbol, s_acctbal / 10000 AS score FROM supplier WHERE s_acctbal / 10000 >= 0.1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, name) AS rank, count(*) OVER (PARTITION BY symbol) AS members FROM r)
SELECT name, symbol, rank::INT AS rank, members, round(score, 6) AS score FROM k WHERE rank <= 3 AND members >= 2""")  # fmt: skip
register("leaderboard", lambda s, d: results(s, d).orderBy(F.desc("mcc"), "name").limit(10).select("name", F.round("mcc", 6).alias("mcc")),
         "SELECT s_name AS name, round(s_acctbal / 10000, 6) AS mcc FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 10")


#: Trials of the objectives: lengths of the fast and the slow average.
LENGTHS = [(f, n) for f in (1, 2, 3) for n in (4, 10)]


def fading(b: DataFrame, trials: DataFrame) -> DataFrame:
    """Signals against the crossings of two averages: these bars return to their mean."""
    return search.crossing_means(b, trials, against=True).withColumn("combined_signal", F.round("combined_signal", 9))


def hourly(spark, sf_dir: str) -> DataFrame:
    return source.indexed(source.event_bars(spark, sf_dir, "1h"))


def trial_objectives(spark, sf_dir: str) -> DataFrame:
    """Walk-forward objective of every trial over the hourly bars of all symbols, by one job."""
    trials = search.trial_rows(spark, [{"fast": float(f), "slow": float(n)} for f, n in LENGTHS])
    found = search.walk_forward_objective(fading, hourly(spark, sf_dir), trials, HORIZONS, 2, 5, 1, 30)
    return found.withColumn("rejected", F.col("objective") == float("-inf")).withColumn("objective", F.round(F.when(~F.col("rejected"), F.col("objective")), 4))


def trial_returns(spark, sf_dir: str) -> DataFrame:
    """Mean profit of every crossing of the grid."""
    trials = search.grid(spark, {"fast": (3.0, 6.0, 3.0), "slow": (10.0, 20.0, 10.0)}).withColumn("trial_id", (F.col("fast") * 100 + F.col("slow")).cast("long"))
    return search.crossover_returns(bars(spark, sf_dir), trials, 6, 1).withColumn("objective", F.round("objective", 4))


_APART = " UNION ALL ".join(
    f"""SELECT * REPLACE (symbol || '#{k}' AS symbol), ({sql.sma('close', n)} - ({sql.sma('close', f)})) / close AS m FROM b0""" for k, (f, n) in enumerate(LENGTHS)
)
_TOP = f"max(abs(m)) OVER {sql.CUM}"
_FADING = f"""WITH bars AS (
  SELECT event_type AS symbol, '1h' AS "interval", time_bucket(INTERVAL '1 hour', ts) AS "timestamp", arg_max(value, ts) AS close FROM events GROUP BY ALL
), b0 AS (
  SELECT *, row_number() OVER ({sql.O}) - 1 AS bar_index FROM bars
), b AS ({_APART}), g AS (
  SELECT *, CASE WHEN m IS NULL OR {_TOP} = 0 THEN 0 ELSE greatest(least(m / {_TOP}, 1), -1) END AS score0,
         coalesce(lag(m) OVER {LAG} <= 0 AND m > 0, false) AS buy_signal, coalesce(lag(m) OVER {LAG} >= 0 AND m < 0, false) AS sell_signal FROM b
)"""
_SCORED = f""", sc AS (
  SELECT split_part(symbol, '#', 2)::BIGINT AS trial_id, mcc, roc_auc, samples, consistency, samples / (samples + 50.0::DOUBLE) AS shrink,
         CASE WHEN samples <= 3 THEN -1 WHEN abs(mcc) >= 0.999 THEN mcc - 0.0196 ELSE tanh(atanh(mcc) - 1.959963984540054::DOUBLE / sqrt(greatest(samples - 3, 1))) END AS ci_low FROM rr
), ob AS (
  SELECT trial_id, coalesce(samples < 100 OR roc_auc < 0.5 OR mcc < 0.02 OR ci_low <= 0, true) AS bad,
         (shrink * mcc + (1 - shrink) * 0.03::DOUBLE) * CASE WHEN consistency < 0.5 THEN 1 - 0.1::DOUBLE * (0.5 - consistency) ELSE 1 END AS o FROM sc
)
SELECT trial_id, bool_or(bad) OR count(*) < (SELECT count(DISTINCT event_type) FROM events) AS rejected,
       CASE WHEN NOT (bool_or(bad) OR count(*) < (SELECT count(DISTINCT event_type) FROM events)) THEN round(avg(o), 4) END AS objective
FROM ob GROUP BY trial_id"""
register("o06_trial_objectives", trial_objectives, ROLL.replace(f"WITH {BARS}, {BASE}", _FADING) + _SCORED)
_TRIALS = ", t AS (" + " UNION ALL ".join(f"SELECT {100 * f + s}::BIGINT AS trial_id, symbol, bar_index, close, lead(close, 6) OVER {LAG} AS later, {sql.sma('close', f)} AS f, {sql.sma('close', s)} AS s FROM b" for f in (3, 6) for s in (10, 20)) + ")"
_PAST = "OVER (PARTITION BY trial_id, symbol ORDER BY bar_index)"
TRIAL_RETURNS_SQL = f"""WITH {BARS}{_TRIALS}, x AS (SELECT *, lag(f) {_PAST} <= lag(s) {_PAST} AND f > s AS up, lag(f) {_PAST} >= lag(s) {_PAST} AND f < s AS down FROM t),
p AS (SELECT trial_id, symbol, avg(CASE WHEN up THEN 1 ELSE -1 END * (later - close) / close * 100) AS r, count(*) AS n FROM x WHERE (up OR down) AND later IS NOT NULL GROUP BY ALL)
SELECT trial_id, round(avg(r), 4) AS objective, CAST(sum(n) AS BIGINT) AS trades FROM p GROUP BY trial_id"""
register("j03_a41_trial_returns", trial_returns, TRIAL_RETURNS_SQL)
def full_scripts(spark, sf_dir: str) -> DataFrame:
    """The scripts with a function, two calculations and inputs of their looks."""
    more = F.concat(F.lit("lineWidth = input.int(2)\nratio = input.float(0.5, maxval=4)\ncurve(x) =>\n    x * 2\nfast = ta.sma(close, fastLen)\n// old = ta.ema(close, 3)\ntop := math.max(fast, close)\n"),
                    F.when(F.length("script") % 2 == 0, F.lit("indicator(overlay = true)\n")).otherwise(F.lit("")))
    return scripts(spark, sf_dir).withColumn("body", F.concat("body", more))


def optimised_scripts(spark, sf_dir: str) -> DataFrame:
    """Every script with new defaults and a header."""
    values = F.create_map(F.lit("fastLen"), F.lit(9.0), F.lit("ratio"), F.lit(0.25), F.lit("showLabels"), F.lit(0.0), F.lit("no(such"), F.lit(1.0))
    return full_scripts(spark, sf_dir).select("script", script.optimised(F.col("body"), values, F.lit("// found")).alias("body"))


_OVERLAY = "CASE WHEN length(n_name) % 2 = 0 THEN 'indicator(overlay = true)' || chr(10) ELSE '' END"
register("l03_calculations", lambda s, d: script.calculations(full_scripts(s, d)).select("script", "name", "expression"),
         "SELECT n_name AS script, 'fast' AS name, 'ta.sma(close, fastLen)' AS expression FROM nation UNION ALL SELECT n_name, 'top', 'math.max(fast, close)' FROM nation")
register("l03_described", lambda s, d: script.described(full_scripts(s, d)).withColumn("functions", F.concat_ws(",", "functions")),
         "SELECT n_name AS script, length(n_name) % 2 = 0 AS overlay, 'curve' AS functions FROM nation")
register("l05_optimised_scripts", optimised_scripts,
         f"""SELECT n_name AS script, '//@version=5' || chr(10) || '// found' || chr(10) || 'indicator("Optimised ' || n_name || '")' || chr(10) || 'fastLen = input.int(9, title="Fast", minval=1, maxval=40)' || chr(10)
|| CASE WHEN n_nationkey % 2 = 0 THEN 'slowLen = input.int(26, minval=20, maxval=60, step=5)' || chr(10) ELSE '' END || 'showLabels = input.bool(false)' || chr(10) || '// old = input.int(3)' || chr(10)
|| CASE WHEN n_nationkey % 3 = 0 THEN 'hline(70)' || chr(10) || 'hline(30)' || chr(10) ELSE '' END || 'lineWidth = input.int(2)' || chr(10) || 'ratio = input.float(0.2500, maxval=4)' || chr(10) || 'curve(x) =>' || chr(10) || '    x * 2' || chr(10)
|| 'fast = ta.sma(close, fastLen)' || chr(10) || '// old = ta.ema(close, 3)' || chr(10) || 'top := math.max(fast, close)' || chr(10) || {_OVERLAY} AS body FROM nation""")  # fmt: skip
register("p06_member_inputs", lambda s, d: script.member_inputs(script.parameters(full_scripts(s, d))).select("script", "name"),
         "SELECT n_name AS script, 'fastLen' AS name FROM nation UNION ALL SELECT n_name, 'slowLen' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_name, 'ratio' FROM nation")
register("a46_scripts_by_folder", lambda s, d: result_tables.by_folder(s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("scripts/"), F.col("n_regionkey").cast("string"), F.lit("/"), "n_name", F.when(F.col("n_nationkey") % 5 == 0, ".txt").otherwise(".pine")).alias("path")), "path"),
         "SELECT 'scripts/' || CAST(n_regionkey AS VARCHAR) AS folder, count(*) AS n FROM nation WHERE n_nationkey % 5 <> 0 GROUP BY ALL")
register("o12_time_budgets", lambda s, d: result_tables.time_budgets(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("script")), 2000).select("script", F.round("seconds", 4).alias("seconds")),
         "SELECT n_name AS script, round(greatest(2000.0::DOUBLE / count(*) OVER (), 60), 4) AS seconds FROM nation")
register("u01_symbols", lambda s, d: source.event_bars(s, d, "4h").select("symbol").union(source.event_bars(s, d, "1d").select("symbol")).distinct(),
         "SELECT DISTINCT event_type AS symbol FROM events")


def staged_search(spark, sf_dir: str) -> DataFrame:
    """The trials of a two-stage search over averages, and their walk-forward objectives: coarsely on
    the first symbol, then as given on all."""

    def evaluate(some_bars: DataFrame, trials: DataFrame, how: dict) -> DataFrame:
        return search.walk_forward_objective(fading, some_bars, trials, how["horizons"], how["n_folds"], how["embargo"], 1, 30, min_trades=how["min_trades"])

    fine = {"horizons": HORIZONS, "n_folds": 3, "embargo": 8, "min_trades": 3}
    found = search.two_stages(evaluate, hourly(spark, sf_dir), {"fast": (1.0, 3.0, 1.0), "slow": (4.0, 12.0, 1.0)}, 2, 6, fine)
    rows = [(stage, k, v["fast"], v["slow"], x if math.isfinite(x) else None) for stage, trials in enumerate(found) for k, (v, x) in enumerate(trials)]
    return spark.createDataFrame(rows, "stage int, trial int, fast double, slow double, objective double").withColumn("objective", F.round("objective", 4))


register("o11_two_stages", staged_search)
