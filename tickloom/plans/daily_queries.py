"""One query of each class on the daily bars of all suppliers, the largest bar relation of the tables:
windows, labels, walk-forward evaluation, and trials. Their SQL is that of the 4-hour bars, over other
bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import backtest, indicators, search
from tickloom.plans import sql
from tickloom.plans.evaluation_queries import ALL_SQL, AUC, COUNTS, EVALUATED, FOLD_SQL, FOLDS, HORIZONS, LABEL_SQL, MCC, REALS_SQL, ROC, ROLL, ROLLED, fold_cte, label_cte, shown
from tickloom.plans.registry import register
from tickloom.plans.search_queries import TRIAL_RETURNS_SQL
from tickloom.sources import bars as source

DAILY = """
ticks AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS "timestamp", l_extendedprice / l_quantity AS p, l_quantity AS v,
         {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_extendedprice, 'e': l_quantity} AS at_
  FROM lineitem
), bars AS (
  SELECT symbol, '1d' AS "interval", "timestamp", arg_min(p, at_) AS open, max(p) AS high, min(p) AS low, arg_max(p, at_) AS close, sum(v) AS volume
  FROM ticks GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, "interval" ORDER BY "timestamp") - 1 AS bar_index FROM bars
)"""


def on_daily(statement: str) -> str:
    """A statement over the 4-hour bars, over the daily ones."""
    return statement.replace(sql.BARS, DAILY)


def bars(spark, sf_dir: str) -> DataFrame:
    return source.indexed(source.lineitem_bars(spark, sf_dir, by_series=True))


def example(spark, sf_dir: str) -> DataFrame:
    signals = indicators.directional(indicators.finish(indicators.generic(bars(spark, sf_dir), "roc"), 5))
    return signals.withColumn("combined_signal", F.round("combined_signal", 9))


def windows(spark, sf_dir: str) -> DataFrame:
    close = F.col("close")
    made = bars(spark, sf_dir).withColumns({"mean": series.sma(close, 20), "spread": series.stdev(close, 20), "top": series.highest(F.col("high"), 20)})
    return made.select("symbol", "bar_index", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"), "top")


register("w_daily_windows", windows, on_daily(sql.over_bars(f"round({sql.sma('close', 20)}, 4) AS mean, round({sql.stdev('close', 20)}, 4) AS spread, max(high) OVER {sql.rows(20)} AS top")))


def label_counts(spark, sf_dir: str) -> DataFrame:
    """Classification by symbol and horizon of all labelled rows within folds, and their AUC."""
    rows = backtest.labels(backtest.by_fold(backtest.by_horizon(example(spark, sf_dir), HORIZONS), **FOLDS), F.col("combined_signal"))
    counts = backtest.scored_counts(rows, [*backtest.KEY, "horizon"])  # with the interval, groups lie where their series does
    counts = counts.withColumn("mcc", backtest.mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))
    return shown(counts, "symbol", "horizon", "tp", "fp", "tn", "fn", "mcc", "roc_auc", digits=4)


register("a07_daily_labels", label_counts,
         on_daily(ALL_SQL + f", k AS (SELECT symbol, horizon, {COUNTS.format(t=0)} FROM lab GROUP BY ALL) SELECT k.symbol, k.horizon, tp, fp, tn, fn, round({MCC}, 4) AS mcc, round(a.roc_auc, 4) AS roc_auc FROM k JOIN {AUC.format(k='symbol, horizon', t='lab')} a USING (symbol, horizon)"))


def walked(spark, sf_dir: str) -> DataFrame:
    found = backtest.evaluate(example(spark, sf_dir), HORIZONS, min_train=1, **FOLDS)
    return shown(found, "symbol", "fold", "horizon", "samples", "tp", "fp", "tn", "fn", "mcc", "roc_auc")


register("a20_daily_walk_forward", walked, on_daily(EVALUATED))


def trial_returns(spark, sf_dir: str) -> DataFrame:
    trials = search.grid(spark, {"fast": (3.0, 6.0, 3.0), "slow": (10.0, 20.0, 10.0)}).withColumn("trial_id", (F.col("fast") * 100 + F.col("slow")).cast("long"))
    return search.crossover_returns(bars(spark, sf_dir), trials, 6, 1).withColumn("objective", F.round("objective", 4))


register("j03_daily_trial_returns", trial_returns, on_daily(TRIAL_RETURNS_SQL))


#: Horizons of bars under four hours; what suits both intervals here, by hand: folds, embargo, least
#: trades, horizons.
USUAL = [1, 2, 3, 6, 12, 24]
SUITED = {"1 hour": ("1h", 3, 72, 10, USUAL), "4 hours": ("4h", 3, 18, 5, [1, 2, 3, 4, 6, 8, 12, 16])}


def by_interval(spark, sf_dir: str) -> DataFrame:
    """Roll-ups of hourly and 4-hour bars side by side, each with the folds and horizons of its interval."""
    both = source.event_bars(spark, sf_dir, "1h").unionAll(source.event_bars(spark, sf_dir, "4h"))
    signals = indicators.directional(indicators.generic(source.indexed(both), "roc", 1)).withColumn("combined_signal", F.round("combined_signal", 9))
    found = search.interval_metrics(signals, USUAL, min_train=1, min_test=20)
    return shown(found, "symbol", "interval", "folds", *ROLLED, digits=4)


def _of(unit: str, name: str, folds: int, embargo: int, trades: int, horizons: list[int]) -> str:
    """The roll-up's statement with other bars, folds and horizons, and a least number of trades."""
    some = ROLL.replace(sql.BARS, sql.BARS.replace("'4h'", f"'{name}'").replace("INTERVAL '4 hours'", f"INTERVAL '{unit}'"))
    some = some.replace(ROC, ROC.replace("14", "1")).replace(f"{sql.sma('x', 5)} AS m", "x AS m")  # many trades
    some = some.replace(FOLD_SQL, fold_cte(folds, embargo, 20)).replace(LABEL_SQL, label_cte(horizons)).replace("FROM fm GROUP BY symbol", f"FROM fm WHERE total_trades >= {trades} GROUP BY symbol")
    return f"({some} SELECT symbol, '{name}' AS \"interval\", folds, horizon, samples, tp, fp, tn, fn, total_trades, wins, {REALS_SQL} FROM rr)"


register("o09_by_interval", by_interval, " UNION ALL ".join(_of(unit, *how) for unit, how in SUITED.items()))
