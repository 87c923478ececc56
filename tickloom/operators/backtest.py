"""Walk-forward evaluation as relations: folds, labels, trades, thresholds, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import series

KEY = ["symbol", "interval"]


def _bounds(n: Column, fold: Column, n_folds: int, embargo: int, train_ratio: float, min_test: int) -> dict[str, Column]:
    """Bounds of a fold of a series of n bars, ends exclusive, as columns of the row."""
    size = F.floor(n / n_folds).cast("long")
    train = F.floor(size * train_ratio).cast("long")
    test = size - train - embargo
    short = test < min_test
    train, test = F.when(short, size - min_test - embargo).otherwise(train), F.when(short, F.lit(min_test)).otherwise(test)
    start = (fold * size).cast("long")
    opened = start + train + embargo
    return {"train_start": start, "train_end": start + train, "test_start": opened, "test_end": F.least(opened + test, n)}


def folds(bars: DataFrame, n_folds: int = 5, embargo: int = 72, train_ratio: float = 0.6, min_test: int = 100) -> DataFrame:
    """(symbol, interval, fold, train_start, train_end, test_start, test_end), ends exclusive.

    Consecutive slices of each series; within a slice training comes first, then the embargo. A
    test part under min_test bars takes them from training (which may leave none)."""
    sizes = bars.groupBy(*KEY).agg(F.count("*").alias("n"))
    f = sizes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    bounds = _bounds(F.col("n"), F.col("fold"), n_folds, embargo, train_ratio, min_test)
    return f.select(*KEY, "fold", *[x.alias(c) for c, x in bounds.items()]).where("test_start < test_end")


def by_fold(rows: DataFrame, n_folds: int, embargo: int, train_ratio: float = 0.6, min_test: int = 100) -> DataFrame:
    """Whole series of indexed rows with the folds and parts they lie in, and the folds' bounds: what
    in_folds(rows, folds(rows)) gives, by columns alone, without a join."""
    counted = rows.withColumn("__n", F.max("bar_index").over(Window.partitionBy(*KEY)) + 1)  # a bar may have several rows
    each = counted.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    each = each.withColumns(_bounds(F.col("__n"), F.col("fold"), n_folds, embargo, train_ratio, min_test)).drop("__n")
    i = F.col("bar_index")
    train, test = (i >= F.col("train_start")) & (i < F.col("train_end")), (i >= F.col("test_start")) & (i < F.col("test_end"))
    return each.where((F.col("test_start") < F.col("test_end")) & (train | test)).withColumn("part", F.when(train, "train").otherwise("test"))


def in_folds(bars: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """bars with the fold and part (train or test) they lie in. A series has a handful of folds, so
    the join is an equi-join with a range residual."""
    f = fold_rows.select(*[F.col(k).alias(f"f_{k}") for k in KEY], "fold", "train_start", "train_end", "test_start", "test_end")
    i = F.col("bar_index")
    train, test = (i >= F.col("train_start")) & (i < F.col("train_end")), (i >= F.col("test_start")) & (i < F.col("test_end"))
    on = [F.col(k) == F.col(f"f_{k}") for k in KEY]
    joined = bars.join(f, [*on, train | test]).withColumn("part", F.when(train, "train").otherwise("test"))
    return joined.drop(*[f"f_{k}" for k in KEY])


def by_horizon(bars: DataFrame, horizons: list[int]) -> DataFrame:
    """One row for each bar and horizon with its forward return, in one window pass."""
    returns = bars.select("*", *[series.forward_return(F.col("close"), h).alias(f"__r{h}") for h in horizons])
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__r{h}").alias("forward_return")) for h in horizons])
    return returns.select(*bars.columns, F.explode(rows).alias("__h")).select(*bars.columns, "__h.*")


def score_of(buy: Column, sell: Column) -> Column:
    """1 for a buy, -1 for a sell, a buy winning, else 0."""
    return F.when(buy, F.lit(1.0)).when(sell, F.lit(-1.0)).otherwise(F.lit(0.0))


def labels(rows: DataFrame, score: Column) -> DataFrame:
    """label and score of rows whose forward return is known and not zero."""
    r = F.col("forward_return")
    return rows.withColumn("score", score).where(r.isNotNull() & (r != 0) & F.col("score").isNotNull()).withColumn("label", (r > 0).cast("int"))


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    tp, fp, tn, fn = (x.cast("double") for x in (tp, fp, tn, fn))
    square = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(square > 0, (tp * tn - fp * fn) / F.sqrt(square)).otherwise(F.lit(0.0))


#: Digits of an MCC that a choice compares: equal ones differ in their last bits, by how they are divided.
CHOICE_DIGITS = 12


def confusion(label: Column, predicted: Column) -> list[Column]:
    yes, up = label == 1, F.coalesce(predicted, F.lit(False))
    return [F.count_if(yes & up).alias("tp"), F.count_if(~yes & up).alias("fp"), F.count_if(~yes & ~up).alias("tn"), F.count_if(yes & ~up).alias("fn")]


def by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score: what curves and ranks need, and no more."""
    return rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by mean ranks; 0.5 where one class is missing."""
    return scored_counts(rows, keys).select(*keys, "roc_auc")


def scored_counts(rows: DataFrame, keys: list[str], threshold: float = 0.0) -> DataFrame:
    """tp, fp, tn and fn of scores from the threshold on, and roc_auc, from one aggregate by score."""
    s = by_score(rows, keys).withColumn("below", F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2))
    pairs = F.sum("p").cast("double") * F.sum("q").cast("double")
    up = F.col("score") >= threshold
    counts = {"tp": F.when(up, F.col("p")), "fp": F.when(up, F.col("q")), "tn": F.when(~up, F.col("q")), "fn": F.when(~up, F.col("p"))}
    return s.groupBy(*keys).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in counts.items()], F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.5)).alias("roc_auc"))


def best_threshold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The score that as a threshold gives the greatest MCC (ties: the highest score). Where none
    beats predicting nothing, a threshold just over the greatest score."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    s = by_score(rows, keys).withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w), "P": F.sum("p").over(every), "Q": F.sum("q").over(every)})
    s = s.withColumn("mcc", F.round(mcc(F.col("tp"), F.col("fp"), F.col("Q") - F.col("fp"), F.col("P") - F.col("tp")), CHOICE_DIGITS))
    best = s.groupBy(*keys).agg(F.max_by("score", F.struct("mcc", "score")).alias("at"), F.max("mcc").alias("train_mcc"), F.max("score").alias("top"))
    none = F.col("train_mcc") <= 0
    return best.select(*keys, F.when(none, F.col("top") + 1e-9).otherwise(F.col("at")).alias("threshold"), F.greatest("train_mcc", F.lit(0.0)).alias("train_mcc"))


def best_horizon(thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Horizon and threshold of the greatest training MCC per fold (ties: the smallest horizon)."""
    best = F.max_by(F.struct("horizon", "threshold", "train_mcc"), F.struct("train_mcc", -F.col("horizon"))).alias("b")
    return thresholds.groupBy(*keys).agg(best).select(*keys, "b.*")


def trades(signals: DataFrame, horizon: int) -> DataFrame:
    """A fixed-horizon trade for each signal bar, long for a buy, short for a sell."""
    exit_price = F.lead("close", horizon).over(series.by_series())
    sides = F.array_compact(F.array(F.when(F.col("buy_signal"), F.lit(1)), F.when(F.col("sell_signal"), F.lit(-1))))
    rows = signals.withColumn("exit_price", exit_price).withColumn("side", F.explode(sides)).where(F.col("exit_price").isNotNull())
    move = F.try_divide(F.col("exit_price") - F.col("close"), F.col("close")) * 100
    carried = [c for c in ("fold", "part") if c in signals.columns]
    return rows.select(
        *KEY, *carried, F.col("bar_index").alias("entry_bar"), (F.col("bar_index") + horizon).alias("exit_bar"), F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"),
        F.col("close").alias("entry_price"), "exit_price", (move * F.col("side")).alias("return_pct"), F.lit(horizon).alias("holding_bars"),
    )


#: Level of the combined signal that a directional trade crosses.
CROSSING = 0.3


def directional_signals(rows: DataFrame, keys: list[str], level: float = CROSSING) -> DataFrame:
    """rows with buy_signal and sell_signal where combined_signal passes +level or -level; before
    the first row of a group it counts as 0, so that a part of a series stands alone."""
    x, before = F.col("combined_signal"), F.coalesce(F.lag("combined_signal").over(Window.partitionBy(*keys).orderBy("bar_index")), F.lit(0.0))
    up, down = (x > level) & (before <= level), (x < -level) & (before >= -level)
    return rows.withColumns({"buy_signal": F.coalesce(up, F.lit(False)), "sell_signal": F.coalesce(down, F.lit(False))})


def trade_metrics(trade_rows: DataFrame, keys: list[str], interval_hours: float = 1.0) -> DataFrame:
    """Counts, returns, profit factor, Sharpe ratio and drawdown of trades in order of entry."""
    order = Window.partitionBy(*keys).orderBy("entry_bar", "direction").rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("return_pct")
    t = trade_rows.withColumn("equity", 100 * F.exp(F.sum(F.ln(F.greatest(1 + r / 100, F.lit(1e-12)))).over(order)))
    t = t.withColumn("drawdown", (F.col("equity") / F.max("equity").over(order) - 1) * 100)
    gain, loss = F.sum(F.greatest(r, F.lit(0.0))), -F.sum(F.least(r, F.lit(0.0)))
    sd = F.stddev_pop(r)
    return t.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("total_return"), F.avg(r).alias("avg_return"), (F.count_if(r > 0) / F.count("*")).alias("win_rate"),
        F.when(loss > 0, gain / loss).when(gain > 0, F.lit(10.0)).otherwise(F.lit(0.0)).alias("profit_factor"),
        F.when((F.count("*") > 1) & (sd > 0), F.avg(r) / sd * F.lit((8760 / interval_hours) ** 0.5)).otherwise(F.lit(0.0)).alias("sharpe"),
        F.least(F.lit(100.0), F.abs(F.min("drawdown"))).alias("max_drawdown"), F.avg("holding_bars").alias("avg_holding"),
    )


def regimes(rows: DataFrame, volatility: Column, keys: list[str]) -> DataFrame:
    """rows with `vol` and `regime`: low, medium or high volatility by the terciles of the group, which
    are summed up once a group and joined."""
    v = rows.withColumn("vol", volatility)
    cuts = v.groupBy(*keys).agg(F.percentile("vol", F.lit(0.33)).alias("__p33"), F.percentile("vol", F.lit(0.67)).alias("__p67"))
    regime = F.when(F.col("vol") <= F.col("__p33"), "low").when(F.col("vol") <= F.col("__p67"), "medium").when(F.col("vol").isNotNull(), "high")
    return v.join(cuts, keys).withColumn("regime", regime).drop("__p33", "__p67")


def _outcomes(signals: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_test: int, long: Column, short: Column) -> DataFrame:
    """For each series, fold, horizon and score: positives and negatives of training rows whose return
    is known before training ends (p, q), of test rows (up, down), and of all test rows with a known
    return how many were said to rise or fall, and rightly. All of it lies in the series' partition."""
    rows = by_fold(by_horizon(signals, horizons), n_folds, embargo, min_test=min_test).withColumn("score", F.col("combined_signal"))
    r, safe = F.col("forward_return"), F.col("bar_index") < F.least("train_end", "test_start") - F.col("horizon")
    labelled, test = (r != 0) & F.col("score").isNotNull(), F.col("part") == "test"
    train = labelled & ~test & safe
    return rows.where(r.isNotNull()).groupBy(*KEY, "fold", "horizon", "score").agg(
        F.count_if(train & (r > 0)).alias("p"), F.count_if(train & (r < 0)).alias("q"), F.count_if(labelled & test & (r > 0)).alias("up"), F.count_if(labelled & test & (r < 0)).alias("down"),
        F.count_if(test & (long | short)).alias("said"), F.count_if(test & ((long & (r > 0)) | (short & (r < 0)))).alias("right"),
    )


def _chosen(outcomes: DataFrame, min_train: int) -> DataFrame:
    """The horizon and threshold of each fold, chosen on its training rows, and what they give on its
    test rows: as best_threshold, best_horizon, confusion and roc_auc do one by one."""
    keys = [*KEY, "fold", "horizon"]
    group = Window.partitionBy(*keys)
    falling, below = (group.orderBy(x).rowsBetween(Window.unboundedPreceding, k) for x, k in ((F.desc("score"), 0), (F.col("score"), -1)))
    p, q, up, down, score = (F.col(c) for c in ("p", "q", "up", "down", "score"))
    s = outcomes.withColumns({"tp": F.sum("p").over(falling), "fp": F.sum("q").over(falling), "ps": F.sum("p").over(group), "qs": F.sum("q").over(group), "below": F.coalesce(F.sum(F.when(score.isNotNull(), down)).over(below), F.lit(0))})
    gained = F.round(mcc(F.col("tp"), F.col("fp"), F.col("qs") - F.col("fp"), F.col("ps") - F.col("tp")), CHOICE_DIGITS)
    s = s.withColumn("gain", F.when(p + q > 0, F.struct(gained.alias("mcc"), "score")))
    s = s.withColumns({"best": F.max("gain").over(group), "top": F.max(F.when(p + q > 0, score)).over(group)})
    none = F.col("best.mcc") <= 0
    s = s.withColumns({"threshold": F.when(none, F.col("top") + 1e-9).otherwise(F.col("best.score")), "train_mcc": F.greatest("best.mcc", F.lit(0.0))})
    over = score >= F.col("threshold")
    wins, pairs = F.sum(up * (F.col("below") + down / 2)), F.sum("up").cast("double") * F.sum("down").cast("double")
    sums = {"tp": F.when(over, up), "fp": F.when(over, down), "tn": F.when(over, 0).otherwise(down), "fn": F.when(over, 0).otherwise(up), "samples": up + down, "said": F.col("said"), "right": F.col("right")}
    each = s.where((F.col("ps") + F.col("qs") >= min_train) & F.col("best").isNotNull()).groupBy(*keys, "threshold", "train_mcc").agg(
        *[F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in sums.items()], F.when(pairs > 0, wins / pairs).otherwise(F.lit(0.5)).alias("roc_auc")
    )
    kept = F.struct("horizon", "threshold", "train_mcc", *sums, "roc_auc")
    best = each.groupBy(*KEY, "fold").agg(F.max_by(kept, F.struct(F.col("train_mcc"), -F.col("horizon"))).alias("b"))
    return best.select(*KEY, "fold", "b.*")


def fold_metrics(signals: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_train: int = 30, min_test: int = 100, discrete: bool = True, interval_hours: float = 1.0) -> DataFrame:
    """One row per series and fold: classification, trades and directional accuracy on test rows.
    Discrete signals trade on buys and sells, others where the combined signal crosses CROSSING.

    Rows are dealt by series once; folds are columns of the row, one aggregate by score carries what
    choice and classification need, and the trades meet the fold's choice in the same partition."""
    keys, x = [*KEY, "fold"], F.col("combined_signal")
    long, short = (F.col("buy_signal"), F.col("sell_signal")) if discrete else (x > CROSSING, x < -CROSSING)
    chosen = _chosen(_outcomes(signals, horizons, n_folds, embargo, min_test, F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False))), min_train).where("samples > 0")
    test = by_fold(by_horizon(signals, horizons), n_folds, embargo, min_test=min_test).where("part = 'test'").join(chosen.select(*keys, "horizon"), [*keys, "horizon"], "left_semi")
    entries = (test if discrete else directional_signals(test, keys)).where("forward_return IS NOT NULL")
    sides = F.array_compact(F.array(F.when(F.col("buy_signal"), F.lit(1)), F.when(F.col("sell_signal"), F.lit(-1))))
    made = entries.withColumn("side", F.explode(sides)).select(
        *keys, F.col("bar_index").alias("entry_bar"), F.when(F.col("side") > 0, "long").otherwise("short").alias("direction"), (F.col("forward_return") * F.col("side")).alias("return_pct"), F.col("horizon").alias("holding_bars")
    )
    traded = trade_metrics(made, keys, interval_hours)
    accuracy = F.when(F.col("said") > 0, F.col("right") / F.col("said")).otherwise(F.lit(0.5))
    counts = chosen.withColumns({"mcc": mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")), "accuracy": accuracy}).drop("train_mcc", "said", "right")
    return counts.join(traded, keys, "left").na.fill(0, ["total_trades", "wins", "total_return", "avg_return", "win_rate", "profit_factor", "sharpe", "max_drawdown"])


def steadiness(values: Column) -> Column:
    """1 / (1 + coefficient of variation) of a group's values; 0 where their mean is not positive."""
    mean = F.avg(values)
    return F.when(mean > 0, 1 / (1 + F.stddev_pop(values) / mean)).otherwise(F.lit(0.0))


def consistency() -> Column:
    """Steadiness of profit factor and accuracy over the folds that traded, in the mean."""
    traded = F.col("total_trades") > 0
    return ((steadiness(F.when(traded, F.col("profit_factor"))) + steadiness(F.when(traded, F.col("accuracy")))) / 2).alias("consistency")


def _summed() -> list[Column]:
    auc = F.when(F.sum("samples") > 0, F.sum(F.col("roc_auc") * F.col("samples")) / F.sum("samples")).otherwise(F.lit(0.5))
    return [*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "samples", "total_trades", "wins")], auc.alias("roc_auc"), F.median("horizon").cast("int").alias("horizon"), F.median("threshold").alias("threshold")]


#: Measures of trades that roll-ups average where the rows have them.
_AVERAGED = ("avg_return", "win_rate", "sharpe", "avg_holding", "tail_capture")


def _averaged(rows: DataFrame) -> list[Column]:
    return [F.avg(c).alias(c) for c in _AVERAGED if c in rows.columns]


def roll_up(fold_rows: DataFrame, keys: list[str], min_samples: int = 1, min_trades: int = 0) -> DataFrame:
    """One row per series from its folds (those with samples and trades enough): counts are summed
    and the MCC is of the sums, the AUC is weighted by samples, horizon and threshold are medians."""
    valid = fold_rows.where((F.col("samples") >= min_samples) & (F.col("total_trades") >= min_trades))
    out = valid.groupBy(*keys).agg(F.count("*").alias("folds"), *_summed(), F.avg("accuracy").alias("accuracy"), F.sum("total_return").alias("total_return"), F.max("max_drawdown").alias("max_drawdown"), F.avg("profit_factor").alias("profit_factor"), consistency(), *_averaged(valid))
    better = F.when(F.col("roc_auc") > 0.5, (F.col("roc_auc") - 0.5) / 0.5 * 100).otherwise(F.lit(0.0))
    return out.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).withColumn("improvement", better)


def across_symbols(series_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key from its series that traded: sums, means, the greatest drawdown, medians. A
    key with a series of MCC under -0.1 has none: its mean would hide that series."""
    out = series_rows.where("total_trades > 0").groupBy(*keys).agg(
        F.count("*").alias("series"), F.min("mcc").alias("worst"), *_summed(), *[F.avg(c).alias(c) for c in ("accuracy", "total_return", "profit_factor", "consistency", "improvement")], F.max("max_drawdown").alias("max_drawdown"), *_averaged(series_rows)
    )
    return out.where(F.col("worst") >= -0.1).withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).drop("worst")


def average_objective(rows: DataFrame, keys: list[str], objective: Column) -> DataFrame:
    """Mean objective over a key's rows; one that is not finite rejects them all (minus infinity)."""
    x = F.coalesce(objective, F.lit(float("-inf")))
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.groupBy(*keys).agg(F.when(F.max(bad.cast("int")) == 1, F.lit(float("-inf"))).otherwise(F.avg(x)).alias("objective"))


def usable_horizons(horizons: list[int], n_train: int) -> list[int]:
    """Distinct horizons, ascending, that fit in the training part; else the longest that does, or 1."""
    fit = sorted({h for h in horizons if 1 <= h <= n_train - 1})
    return fit or [max(1, n_train - 1)] if n_train > 2 else [1]


def data_usage(fold_rows: DataFrame) -> DataFrame:
    """Per series: bars trained and tested on, bars in neither, and whether test parts overlap."""
    w = Window.partitionBy(*KEY).orderBy("test_start")
    f = fold_rows.withColumn("overlap", F.coalesce(F.lag("test_end").over(w) > F.col("test_start"), F.lit(False)))
    used = F.sum(F.col("train_end") - F.col("train_start")), F.sum(F.col("test_end") - F.col("test_start"))
    return f.groupBy(*KEY).agg(F.count("*").alias("folds"), used[0].alias("train_bars"), used[1].alias("test_bars"), F.max("test_end").alias("last_bar"), F.max("overlap").alias("overlap"), F.min(F.col("test_start") - F.col("train_end")).alias("least_gap"))


def evaluate(signals: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_train: int = 30, min_test: int = 100) -> DataFrame:
    """One row per series and fold: horizon and threshold chosen on training rows, MCC and AUC on
    test rows. signals: indexed bars with combined_signal."""
    no = F.lit(False)
    chosen = _chosen(_outcomes(signals, horizons, n_folds, embargo, min_test, no, no), min_train).where("samples > 0")
    return chosen.withColumn("mcc", mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).drop("train_mcc", "said", "right")
