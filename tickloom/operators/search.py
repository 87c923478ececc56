"""Parameter search: candidate vectors are rows, and one job evaluates a batch of them.

A small batch of trials is broadcast to the bars; every (trial, series) is an independent group, so
the width of a job is trials times series. The driver only sees one row per trial.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import scalar, series
from tickloom.operators import backtest, indicators, stats
from tickloom.operators import trials as trials_of
from tickloom.operators.script import optimizable
from tickloom.operators.trials import Space, Stops, TrialLog, stop_reason
from tickloom.sources import bars as source

#: Most trials of one batch, the bound of what is broadcast.
MAX_BATCH = 4096


def space_of(params: DataFrame) -> Space:
    rows = optimizable(params).select("name", "min_value", "max_value", "step").collect()
    return {r["name"]: (r["min_value"], r["min_value"] + math.floor((r["max_value"] - r["min_value"]) / r["step"] + 1e-9) * r["step"], r["step"]) for r in rows}


def grid(spark: SparkSession, space: Space) -> DataFrame:
    """Every vector of a space, as (trial_id, one column per parameter)."""
    df = spark.range(1).select(F.lit(0).alias("__one"))
    for name, (low, high, step) in space.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(low + k * step) for k in range(int((high - low) / step + 1e-9) + 1)])))
    return df.drop("__one").withColumn("trial_id", F.xxhash64(*space))


def parzen_batch(space: Space, n: int, seen: Sequence[tuple[dict[str, float], float]], rng: np.random.Generator, startup: int = 20, candidates: int = 24) -> list[dict[str, float]]:
    """Tree-structured Parzen estimator, each parameter by itself (Bergstra et al. 2011): draw near
    good trials, keep what is likelier under the good than under the rest. Random until `startup`
    trials are known. Vectors may come twice; trials.joint_batch is the search's own sampler."""
    known = [x for x in seen if math.isfinite(x[1])]
    if len(known) < startup:
        return trials_of.random_batch(space, n, rng)
    known.sort(key=lambda x: -x[1])
    cut = max(2, math.ceil(0.25 * math.sqrt(len(known))))
    out: list[dict[str, float]] = []
    for _ in range(n):
        vector = {}
        for k, (low, high, step) in space.items():
            good, rest = (np.array([x[0][k] for x in part]) for part in (known[:cut], known[cut:]))
            width = max((high - low) / 5, step)
            draws = np.clip(np.round((rng.choice(good, candidates) + rng.normal(0, width, candidates) - low) / step) * step + low, low, high)

            def density(c: np.ndarray, at=draws, w=width) -> np.ndarray:
                return np.exp(-0.5 * ((at[:, None] - c) / w) ** 2).mean(axis=1) + 1e-3

            vector[k] = float(draws[np.argmax(density(good) / density(rest))])
        out.append(vector)
    return out


def trial_rows(spark: SparkSession, vectors: list[dict[str, float]], first: int = 0) -> DataFrame:
    if len(vectors) > MAX_BATCH:
        raise ValueError("a batch is too large to broadcast")
    names = list(vectors[0])
    return spark.createDataFrame([(first + i, *[float(v[k]) for k in names]) for i, v in enumerate(vectors)], "trial_id long, " + ", ".join(f"{k} double" for k in names))


def fan_out(bars: DataFrame, trials: DataFrame) -> DataFrame:
    """Every trial with every bar; the interval column becomes the series of one trial."""
    return bars.crossJoin(trials).withColumn("interval", F.concat_ws("#", "interval", F.col("trial_id").cast("string")))


def with_past_sums(bars: DataFrame, lengths: DataFrame) -> DataFrame:
    """bars with __s, the sum of close up to each, and __past, from every length n to the sum up to n
    bars before. Each bar hands its sum on to the bars that it is past of, by their number: all of it
    is grouped where the series lies, and a length is met once for all trials that use it."""
    wanted = lengths.select("n").where("n > 0").distinct().unionAll(lengths.sparkSession.range(1).select(F.lit(0).alias("n")))
    summed = bars.withColumn("__s", F.sum("close").over(series.so_far())).crossJoin(F.broadcast(wanted))
    rest = [c for c in bars.columns if c not in backtest.KEY]
    own = F.when(F.col("n") == 0, F.struct(*rest, "__s"))
    handed = summed.select(*backtest.KEY, (F.col("bar_index") + F.col("n")).alias("__to"), own.alias("__bar"), F.when(F.col("n") > 0, F.struct("n", "__s")).alias("__sum"))
    met = handed.groupBy(*backtest.KEY, "__to").agg(F.first("__bar", ignorenulls=True).alias("__bar"), F.map_from_entries(F.collect_list("__sum")).alias("__past"))
    return met.where("__bar IS NOT NULL").select(*[F.col(c if c in backtest.KEY else f"__bar.{c}") for c in bars.columns], "__bar.__s", "__past")


def with_means(bars: DataFrame, trials: DataFrame) -> DataFrame:
    """fan_out of the trials (trial_id, fast, slow) with `fast_mean` and `slow_mean`, missing until
    that many bars are there."""
    lengths = trials.select(F.explode(F.array(F.col("fast").cast("int"), F.col("slow").cast("int"))).alias("n"))
    rows = with_past_sums(bars, lengths).crossJoin(F.broadcast(trials))
    for name in ("fast", "slow"):
        n = F.col(name).cast("int")
        mean = (F.col("__s") - F.coalesce(F.try_element_at("__past", n), F.lit(0.0))) / n
        rows = rows.withColumn(f"{name}_mean", F.when(F.col("bar_index") >= n - 1, mean))
    rows = rows.drop("__s", "__past")
    return rows.withColumn("interval", F.concat_ws("#", "interval", F.col("trial_id").cast("string")))


def crossover_returns(bars: DataFrame, trials: DataFrame, horizon: int = 6, min_trades: int = 5) -> DataFrame:
    """(trial_id, objective, trades): mean over symbols of the profit of an average-crossover with
    the trial's fast and slow lengths; a symbol with too few trades rejects the trial."""
    rows = with_means(bars, trials)
    up, down = series.crossover(F.col("fast_mean"), F.col("slow_mean")), series.crossunder(F.col("fast_mean"), F.col("slow_mean"))
    rows = rows.withColumn("buy_signal", up).withColumn("sell_signal", down)
    made = backtest.trades(rows, horizon).withColumn("trial_id", F.element_at(F.split("interval", "#"), -1).cast("long"))
    every = bars.select("symbol").distinct().crossJoin(trials.select("trial_id"))
    per = made.groupBy("trial_id", "symbol").agg(F.avg("return_pct").alias("r"), F.count("*").alias("n"))
    per = every.join(per, ["trial_id", "symbol"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return per.groupBy("trial_id").agg(F.when(F.min("n") < min_trades, F.lit(float("-inf"))).otherwise(F.avg("r")).alias("objective"), F.sum("n").alias("trades"))


def walk_forward_objective(
    signals: Callable[[DataFrame, DataFrame], DataFrame], bars: DataFrame, trials: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_train: int = 30, min_test: int = 100, interval_hours: float = 1.0, min_samples: int = 1, min_trades: int = 0
) -> DataFrame:
    """(trial_id, objective) of every trial in one job: all trials' signals are evaluated walk-forward
    side by side, folds with samples and trades enough are rolled up per series, and the objective is
    the mean over a trial's series, of which one rejected, or without such a fold, rejects the trial.
    signals: bars and trials to every trial's bars, as fan_out names them, with main_value and the
    signal columns."""
    series_rows = _by_series(signals, bars, trials, horizons, n_folds, embargo, min_train, min_test, interval_hours, min_samples, min_trades)
    return _objectives(series_rows, trials)


def _by_series(signals: Callable, bars: DataFrame, trials: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_train: int, min_test: int, interval_hours: float, min_samples: int, min_trades: int) -> DataFrame:
    """A row for every trial and series, its measures missing where no fold holds."""
    per_fold = backtest.fold_metrics(signals(bars, trials), horizons, n_folds, embargo, min_train, min_test, interval_hours=interval_hours)
    found = backtest.roll_up(per_fold, backtest.KEY, min_samples, min_trades)
    every = bars.select(*backtest.KEY).distinct().crossJoin(trials.select("trial_id")).withColumn("interval", F.concat_ws("#", "interval", F.col("trial_id").cast("string")))
    return every.join(found, backtest.KEY, "left")


def _objectives(series_rows: DataFrame, trials: DataFrame) -> DataFrame:
    low, _ = stats.mcc_interval(F.col("mcc"), F.col("samples"))
    score = stats.objective(F.col("mcc"), F.col("roc_auc"), F.col("samples"), F.col("consistency"), low)
    found = backtest.average_objective(series_rows, ["trial_id"], F.when(F.col("samples").isNotNull(), score))
    return trials.select("trial_id").join(found, "trial_id", "left").select("trial_id", F.coalesce("objective", F.lit(float("-inf"))).alias("objective"))


def trial_metrics(
    signals: Callable[[DataFrame, DataFrame], DataFrame], bars: DataFrame, trials: DataFrame, horizons: list[int], n_folds: int, embargo: int, min_train: int = 30, min_test: int = 100, interval_hours: float = 1.0, min_samples: int = 1, min_trades: int = 0
) -> DataFrame:
    """(trial_id, objective and all measures across its series) of every trial, in one job."""
    series_rows = _by_series(signals, bars, trials, horizons, n_folds, embargo, min_train, min_test, interval_hours, min_samples, min_trades)
    return _objectives(series_rows, trials).join(backtest.across_symbols(series_rows, ["trial_id"]), "trial_id", "left")


def re_evaluated(measure: Callable[[DataFrame], DataFrame], spark: SparkSession, start: dict, best: dict) -> DataFrame:
    """Two rows, `which` start and best, with their parameters and all measures, by one job over all
    horizons; `kept` marks the one that stays: the start unless the best's objective is greater.
    measure: trials to (trial_id, objective and measures)."""
    trials = trial_rows(spark, [start, best])
    rows = trials.join(measure(trials), "trial_id", "left").withColumn("objective", F.coalesce("objective", F.lit(float("-inf"))))
    both = Window.partitionBy(F.lit(0)).orderBy("trial_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # two rows
    better = F.last("objective").over(both) > F.first("objective").over(both)
    return rows.withColumns({"which": F.when(F.col("trial_id") == 0, "start").otherwise("best"), "kept": better == (F.col("trial_id") == 1)}).drop("trial_id")


def crossing_means(bars: DataFrame, trials: DataFrame, against: bool = False) -> DataFrame:
    """Signals of trials with `fast` and `slow`: crossings of two averages of these lengths;
    main_value is their distance relative to the close, turned round where `against` is set."""
    b = with_means(bars, trials)
    apart = F.col("fast_mean") - F.col("slow_mean")
    b = b.withColumn("main_value", F.try_divide(-apart if against else apart, F.col("close")))
    return indicators.directional(b.drop("fast_mean", "slow_mean"))


def schedule(interval_hours: float, n_bars: int) -> dict:
    """Folds, embargo and least trades for bars of a length: three days of embargo, three bars at
    least; fewer folds for daily bars and short series."""
    return {"n_folds": 3 if interval_hours >= 24 or n_bars < 1500 else 5, "embargo": max(3, round(72 / interval_hours)), "min_trades": 2 if interval_hours >= 24 else 5 if interval_hours >= 4 else 10}


def lockbox(evaluate: Callable[[DataFrame, DataFrame], DataFrame], bars: DataFrame, start: dict, best: dict, ratio: float, gap: int) -> DataFrame:
    """(trial_id, objective) of the start (0) and the best (1) vector on bars no search has seen:
    the end of each series, after a gap. No rows where a series is too short for one."""
    held = source.holdout_split(bars, ratio, gap).where("part = 'holdout'").drop("part", "bar_index")
    return evaluate(source.indexed(held), trial_rows(bars.sparkSession, [start, best]))


#: How the first of two stages evaluates.
COARSE = {"n_folds": 2, "embargo": 5, "min_trades": 2, "horizons": [1, 2, 3, 5, 8, 13]}


def first_series(bars: DataFrame) -> DataFrame:
    """The bars of the first series by symbol and interval."""
    key = bars.agg(F.min(F.struct("symbol", "interval")).alias("key")).first()["key"]
    return bars.where((F.col("symbol") == key["symbol"]) & (F.col("interval") == key["interval"])) if key else bars


def two_stages(evaluate: Callable[[DataFrame, DataFrame, dict], DataFrame], bars: DataFrame, space: Space, batches: int, batch_size: int, fine: dict, seconds: float = math.inf, seed: int = 42, **more) -> tuple[list, list]:
    """Half of the batches and of the time on the first series, evaluated coarsely; then the rest on
    all bars, where the best vector of the first half is tried first. The second half draws by itself,
    knows the trials of the first, and repeats none of them but the best. Returns the trials of both."""
    spark, half = bars.sparkSession, max(1, batches // 2)
    small = first_series(bars)
    coarse = search(lambda trials: evaluate(small, trials, COARSE), spark, space, half, batch_size, seconds=seconds / 2, seed=seed, **more)
    best = max(coarse, key=lambda x: x[1])[0]
    return coarse, search(lambda trials: evaluate(bars, trials, fine), spark, space, max(1, batches - half), batch_size, seconds=seconds / 2, seed=seed + 1, known=coarse, **more | {"start": best})


def settled(evaluate: Callable[[DataFrame], DataFrame], spark: SparkSession, start: dict, best: dict) -> tuple[dict, float, float]:
    """Start and best vector evaluated again, with all horizons: the one that stays (the start unless
    the best is better), and the objectives of both."""
    found = {r["trial_id"]: r["objective"] for r in evaluate(trial_rows(spark, [start, best])).collect()}  # two rows
    old, new = found.get(0, -math.inf), found.get(1, -math.inf)
    return (best if new > old else start), old, new


SAMPLERS = ("parzen", "univariate", "random")


def search(
    evaluate: Callable[[DataFrame], DataFrame], spark: SparkSession, space: Space, batches: int, batch_size: int, sampler: str = "parzen", seed: int = 42, patience: int | None = 3, start: dict | None = None,
    seconds: float = math.inf, known: list[tuple[dict, float]] | None = None, stops: Stops | None = None, log: TrialLog | None = None, told: list[str] | None = None,
) -> list[tuple[dict, float]]:
    """Batches of trials until they run out or a rule stops them; all trials in order, with their
    objectives. `start` is tried first. `known` trials (of a coarser stage) guide the sampler and are
    not tried again. Each batch draws by the seed and its own number, so that a search that goes on
    from a log makes the same trials as one that was never stopped. `told` gets why it ended."""
    if sampler not in SAMPLERS:
        raise ValueError(f"sampler must be one of {SAMPLERS}")
    rules = stops or Stops(seconds=seconds, patience=patience)
    before = log.trials() if log else []
    seen = [(v, x) for _, _, v, x in before]
    history = [(at, x) for _, at, _, x in before]
    ends = [max(at for b, at, _, _ in before if b == k) for k in sorted({b for b, _, _, _ in before})]
    began = time.monotonic() - (ends[-1] if ends else 0.0)
    size = float(np.prod(trials_of.sizes(space).astype(float)))
    reason = stop_reason(rules, ends, history, size) if ends else None
    for b in range(len(ends), batches):
        if reason:
            break
        rng = np.random.default_rng([seed, b])
        earlier = [*(known or []), *seen]
        taken = {trials_of.index_of(space, v) for v, _ in earlier}
        if sampler == "parzen":
            vectors = trials_of.joint_batch(space, batch_size, earlier, rng)
        else:
            vectors = trials_of.random_batch(space, batch_size, rng, taken) if sampler == "random" else parzen_batch(space, batch_size, earlier, rng)
        if b == 0 and start:
            vectors = [dict(start), *[v for v in vectors if v != start]][:batch_size]
        if not vectors:
            reason = "the space is exhausted"
            break
        found = {r["trial_id"]: r["objective"] for r in evaluate(trial_rows(spark, vectors)).collect()}  # a row per trial
        objectives = [found.get(i, -math.inf) for i in range(len(vectors))]
        at = time.monotonic() - began
        if log:
            log.append(b, len(seen), at, vectors, objectives)
        seen += zip(vectors, objectives)
        history += [(at, x) for x in objectives]
        ends.append(at)
        reason = stop_reason(rules, ends, history, size)
    if told is not None:
        told.append(reason or "batches")
    return seen


def pruned(evaluate: Callable[[DataFrame, int], DataFrame], spark: SparkSession, vectors: list[dict], folds: int, warmup: int = 1, least: int = 5) -> list[tuple[dict, float, int]]:
    """(vector, mean objective so far, folds seen) of every vector: one job a fold, and from fold
    `warmup` on a trial whose mean lies under the median of all that are left leaves the later jobs,
    while `least` are left at least. evaluate: trials and a fold to (trial_id, objective)."""
    left, sums, count = list(range(len(vectors))), [0.0] * len(vectors), [0] * len(vectors)
    for f in range(folds):
        rows = trial_rows(spark, [vectors[i] for i in left])
        found = {left[r["trial_id"]]: r["objective"] for r in evaluate(rows, f).collect()}  # a row per trial
        for i in left:
            sums[i], count[i] = sums[i] + found.get(i, -math.inf), count[i] + 1
        if f + 1 >= warmup and f + 1 < folds:
            means = {i: sums[i] / count[i] for i in left}
            middle = float(np.median([m for m in means.values()])) if left else 0.0
            kept = [i for i in left if means[i] >= middle or middle != middle]
            left = kept if len(kept) >= least else sorted(sorted(left, key=lambda i: -means[i])[:least])
    return [(v, sums[i] / max(count[i], 1), count[i]) for i, v in enumerate(vectors)]


def one_fold(bars: DataFrame, fold: int, n_folds: int) -> DataFrame:
    """The bars of one of n consecutive parts of each series, numbered from 0 again."""
    n = F.count("*").over(Window.partitionBy(*backtest.KEY))
    size = F.floor(n / n_folds)
    part = bars.withColumn("__size", size).where((F.col("bar_index") >= fold * F.col("__size")) & (F.col("bar_index") < (fold + 1) * F.col("__size")))
    return part.withColumn("bar_index", F.col("bar_index") - fold * F.col("__size")).drop("__size")


#: Horizons by the length of a bar, from this many seconds on.
HORIZONS = {
    86400: [1, 2, 3, 5, 8, 13, 21, 34, 55],
    14400: [1, 2, 3, 4, 6, 8, 12, 16, 24, 36, 48, 72],
}


def horizons_for(seconds: int | None, n_bars: int, usual: list[int], fast: bool = False) -> list[int]:
    """Horizons for bars of a length: fewer for long bars, none over a tenth of the series; `fast`
    keeps about every sixth part of them, the first and the last among them."""
    found = next((h for least, h in HORIZONS.items() if seconds is not None and seconds >= least), usual)
    found = [h for h in found if h <= max(1, n_bars // 10)] or [1]
    if fast and len(found) > 6:
        step = max(1, len(found) // 6)
        found = sorted({found[0], *found[::step], found[-1]})
    return found


#: Most distinct intervals of one plan, each a branch of it.
MAX_INTERVALS = 16


def interval_metrics(signals: DataFrame, usual: list[int], min_train: int = 30, min_test: int = 100, fast: bool = False) -> DataFrame:
    """One row a series, rolled up from folds that suit its interval: the number of folds, the embargo,
    the least trades of a fold and the horizons follow the length of a bar and of the longest series;
    horizons that do not fit the training part are left out."""
    sizes = signals.groupBy("interval").agg((F.max("bar_index") + 1).alias("n"), F.first(scalar.interval_seconds(F.col("interval"))).alias("seconds"))
    found = sizes.limit(MAX_INTERVALS + 1).collect()  # one row an interval
    if len(found) > MAX_INTERVALS:
        raise ValueError(f"more than {MAX_INTERVALS} intervals")
    parts = []
    for r in sorted(found):
        hours = (r["seconds"] or 3600) / 3600
        how = schedule(hours, r["n"])
        fit = backtest.usable_horizons(horizons_for(r["seconds"], r["n"], usual, fast), int(r["n"] // how["n_folds"] * 0.6))
        rows = backtest.fold_metrics(signals.where(F.col("interval") == r["interval"]), fit, how["n_folds"], how["embargo"], min_train, min_test, interval_hours=hours)
        parts.append(backtest.roll_up(rows, backtest.KEY, 1, how["min_trades"]))
    return reduce(DataFrame.unionByName, parts) if parts else backtest.roll_up(backtest.fold_metrics(signals, [1], 3, 3), backtest.KEY)
