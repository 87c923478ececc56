"""What walk-forward folds use of a series, what may bias them, and how trades fare by regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import backtest

KEY = ["symbol", "interval"]
#: The least embargo in bars, the usual horizon, and the shares of a series that unused
#: bars must not exceed, and that test and training bars must reach.
LEAST_EMBARGO, USUAL_HORIZON, MOST_UNUSED, LEAST_TEST, LEAST_TRAIN = 24, 24, 0.10, 0.05, 0.40


def overlaps(fold_rows: DataFrame) -> DataFrame:
    """(symbol, interval, fold, other, bars): every pair of folds of a series whose test parts share
    bars, once, the lower fold first. A series has a handful of folds."""
    a = fold_rows.select(*KEY, "fold", "test_start", "test_end")
    b = fold_rows.select(*KEY, F.col("fold").alias("other"), F.col("test_start").alias("s"), F.col("test_end").alias("e"))
    shared = F.least("test_end", "e") - F.greatest("test_start", "s")
    return a.join(b, KEY).where((F.col("fold") < F.col("other")) & (shared > 0)).select(*KEY, "fold", "other", shared.alias("bars"))


def fold_usage(bars: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """fold_rows with the bars of both parts and the times of their first and last bars, by position."""
    at = bars.select(*KEY, "bar_index", "timestamp")
    out = fold_rows.withColumns({"train_bars": F.col("train_end") - F.col("train_start"), "test_bars": F.col("test_end") - F.col("test_start"), "embargo_bars": F.col("test_start") - F.col("train_end")})
    places = {"train_from": F.col("train_start"), "train_to": F.col("train_end") - 1, "test_from": F.col("test_start"), "test_to": F.col("test_end") - 1}
    wanted = out.select(*KEY, "fold", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), p.alias("bar_index")) for n, p in places.items()])).alias("p")).select(*KEY, "fold", "p.*")
    times = wanted.join(at, [*KEY, "bar_index"]).groupBy(*KEY, "fold").agg(*[F.max(F.when(F.col("name") == n, F.col("timestamp"))).alias(n) for n in places])
    return out.join(times, [*KEY, "fold"], "left")


def audit(bars: DataFrame, fold_rows: DataFrame, horizon: int = USUAL_HORIZON) -> DataFrame:
    """One row a series: its bars and times, what training, tests and embargoes use, what is unused,
    the number of overlapping pairs of test parts, and `issues`, in words."""
    total = bars.groupBy(*KEY).agg(F.count("*").alias("bars"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    parts = {"train_bars": ("train_end", "train_start"), "test_bars": ("test_end", "test_start"), "embargo_bars": ("test_start", "train_end")}
    used = fold_rows.groupBy(*KEY).agg(F.count("*").alias("folds"), *[F.sum(F.col(a) - F.col(b)).alias(n) for n, (a, b) in parts.items()], F.min(F.col("test_start") - F.col("train_end")).alias("embargo"))
    pairs = overlaps(fold_rows).groupBy(*KEY).agg(F.count("*").alias("overlap_pairs"))
    rows = total.join(used, KEY, "left").join(pairs, KEY, "left").na.fill(0, ["folds", *parts, "overlap_pairs"])
    rows = rows.withColumn("unused_bars", F.greatest(F.col("bars") - F.col("train_bars") - F.col("test_bars") - F.col("embargo_bars"), F.lit(0)))
    share = lambda c: F.col(c) / F.col("bars")
    checks = {
        "test parts overlap": F.col("overlap_pairs") > 0,
        "the embargo is under two horizons": F.col("embargo") < 2 * horizon,
        "the embargo is very short": F.col("embargo") < LEAST_EMBARGO,
        "many bars are unused": share("unused_bars") > MOST_UNUSED,
        "the test parts are small": share("test_bars") < LEAST_TEST,
        "little is trained on": share("train_bars") < LEAST_TRAIN,
    }
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(c, F.lit(text)) for text, c in checks.items()])))


def with_regime(bars: DataFrame, window: int = 20, hours: float = 1.0) -> DataFrame:
    """bars (indexed) with `vol`, the annualised deviation of the returns before each, and `regime`:
    low, medium or high by the terciles of the series."""
    w = series.by_series()
    moved = F.coalesce(F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)), F.lit(0.0))
    moved_bars = bars.withColumn("__r", moved)
    return backtest.regimes(moved_bars, series.trailing_volatility(F.col("__r"), window, hours), KEY).drop("__r")


def trade_regimes(trades: DataFrame, bars: DataFrame, least: int = 5, least_all: int = 20, window: int = 20, hours: float = 1.0) -> DataFrame:
    """Trades by the regime of the bar where each was entered: one row for each series and regime with
    `least` trades at least, of series with `least_all` trades. The Sharpe ratio is of single trades."""
    enough = trades.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= least_all).select(*KEY)
    at = with_regime(bars, window, hours).select(*KEY, F.col("bar_index").alias("entry_bar"), "regime").where("regime IS NOT NULL")
    r = F.col("return_pct")
    found = trades.join(enough, KEY, "left_semi").join(at, [*KEY, "entry_bar"]).groupBy(*KEY, "regime").agg(
        F.count("*").alias("n_trades"), (F.count_if(r > 0) / F.count("*")).alias("win_rate"), F.avg(r).alias("avg_return"), F.sum(r).alias("total_return"),
        F.when(F.stddev_pop(r) > 0, F.avg(r) / F.stddev_pop(r)).otherwise(F.lit(0.0)).alias("sharpe"),
    )
    return found.where(F.col("n_trades") >= least)


def regime_scores(rows: DataFrame, keys: list[str], threshold: Column | float = 0.0) -> DataFrame:
    """Labelled rows (regime, label, score, forward_return) by regime: MCC and accuracy at the
    threshold, and mean and Sharpe ratio of the returns that the score's sign takes."""
    up = F.col("score") >= threshold
    taken = F.signum("score") * F.col("forward_return")
    out = rows.where("regime IS NOT NULL").groupBy(*keys, "regime").agg(
        F.count("*").alias("n"), *backtest.confusion(F.col("label"), up), F.avg(taken).alias("mean_return"),
        F.when(F.stddev_pop(taken) > 0, F.avg(taken) / F.stddev_pop(taken)).otherwise(F.lit(0.0)).alias("sharpe"),
    )
    return out.withColumn("mcc", backtest.mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
