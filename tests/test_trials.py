import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import search, trials
from tickloom.operators.trials import Stops, stop_reason

SPACE = {"fast": (1.0, 40.0, 1.0), "slow": (5.0, 200.0, 5.0)}


def score(v):
    """A narrow ridge: slow must be about five times fast, and fast about 23."""
    return -abs(v["slow"] - 5 * v["fast"]) / 50 - abs(v["fast"] - 23) / 40


def run(sampler, seed, batches=12, width=10):
    seen = []
    for b in range(batches):
        rng = np.random.default_rng([seed, b])
        taken = {trials.index_of(SPACE, v) for v, _ in seen}
        if sampler == "joint":
            batch = trials.joint_batch(SPACE, width, seen, rng)
        else:
            batch = trials.random_batch(SPACE, width, rng, taken) if sampler == "random" else search.parzen_batch(SPACE, width, seen, rng)
        seen += [(v, score(v)) for v in batch]
    return seen


def test_joint_estimator_beats_random_and_univariate_on_a_correlated_objective():
    best = {s: np.mean([max(x for _, x in run(s, seed)) for seed in range(8)]) for s in ("joint", "univariate", "random")}
    assert best["joint"] > best["univariate"] and best["joint"] > best["random"]


def test_no_vector_comes_twice():
    for seed in range(3):
        vectors = [trials.index_of(SPACE, v) for v, _ in run("joint", seed)]
        assert len(set(vectors)) == len(vectors) == 120
    small = {"x": (0.0, 4.0, 1.0), "y": (0.0, 2.0, 1.0)}
    rng = np.random.default_rng(1)
    every = trials.random_batch(small, 99, rng)
    assert len(every) == 15 == len({tuple(v.values()) for v in every})
    known = [(v, float(k)) for k, v in enumerate(every[:13])]
    assert len(trials.joint_batch(small, 9, known, rng, startup=3)) == 2
    pending = [every[13]]
    assert trials.joint_batch(small, 9, known, rng, startup=3, pending=pending) == [every[14]]


def test_small_spaces_start_with_more_random_trials():
    sizes = {(10, 10): 20, (15, 16): 48, (20, 24): 50, (30, 30): 30, (200, 200): 20}
    for (a, b), n in sizes.items():
        assert trials.startup_trials({"x": (1.0, float(a), 1.0), "y": (1.0, float(b), 1.0)}) == n


def test_each_stop_rule():
    history = [(1.0, 1.0), (2.0, 2.0), (3.0, 2.2), (4.0, 0.5), (5.0, -math.inf)]
    ends = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert stop_reason(Stops(), ends, history, 1000) is None
    assert stop_reason(Stops(seconds=5), ends, history, 1000) == "time"
    assert stop_reason(Stops(patience=2), ends, history, 1000) == "patience"
    assert stop_reason(Stops(patience=3), ends, history, 1000) is None
    assert stop_reason(Stops(stall=1), ends, history, 10) == "stall: the space is explored"
    assert stop_reason(Stops(stall=1, min_seconds=9), ends, history, 10) is None
    assert stop_reason(Stops(stall=0.5), ends, history, 1000) == "stall: nothing better for three stalls"
    assert stop_reason(Stops(stall=1, floor=60), ends, history, 1000) == "stall: improvements have become slow"
    assert stop_reason(Stops(stall=1, floor=50), ends, history, 1000) is None  # rates of 100 and 10 a second
    assert stop_reason(Stops(stall=1), [*ends, 6.0], [(1.0, 1.0)], 1000) == "stall: nothing better for three stalls"
    assert stop_reason(Stops(patience=3), ends, [(1.0, -math.inf)], 1000) == "patience"
    assert [round(r) for _, _, r in trials.improvements(history)] == [0, 100, 10]


class Killed(Exception):
    pass


def test_a_killed_search_goes_on_with_the_same_trials(spark, tmp_path):
    calls = []

    def evaluate(rows, die_at=None):
        calls.append(rows.count())
        if die_at is not None and len(calls) > die_at:
            raise Killed
        return rows.select("trial_id", (-F.abs(F.col("slow") - 5 * F.col("fast")) - F.abs(F.col("fast") - 23)).alias("objective"))

    how = dict(batches=6, batch_size=8, patience=None, start={"fast": 2.0, "slow": 10.0})
    whole = search.search(evaluate, spark, SPACE, **how)
    assert len(whole) == 48 and whole[0][0] == how["start"] and len({tuple(v.values()) for v, _ in whole}) == 48
    calls.clear()
    log = trials.TrialLog(spark, f"{tmp_path}/log")
    with pytest.raises(Killed):
        search.search(lambda rows: evaluate(rows, 4), spark, SPACE, log=log, **how)
    assert len(log.trials()) == 32
    calls.clear()
    told = []
    assert search.search(evaluate, spark, SPACE, log=trials.TrialLog(spark, f"{tmp_path}/log"), told=told, **how) == whole
    assert len(calls) == 2 and told == ["batches"]
    calls.clear()
    assert search.search(evaluate, spark, SPACE, log=log, **how) == whole and not calls


def test_search_stops_when_the_space_is_used_up(spark):
    told, small = [], {"x": (0.0, 4.0, 1.0)}
    found = search.search(lambda rows: rows.select("trial_id", F.col("x").alias("objective")), spark, small, 9, 3, patience=None, told=told)
    assert sorted(v["x"] for v, _ in found) == [0, 1, 2, 3, 4] and told == ["the space is exhausted"]


def test_pruned_trials_cost_no_later_fold(spark):
    vectors = [{"x": float(k)} for k in range(16)]
    rows_seen = []

    def evaluate(rows, fold):
        rows_seen.append(rows.count())
        return rows.select("trial_id", (F.col("x") + F.lit(0.1 * fold)).alias("objective"))

    found = search.pruned(evaluate, spark, vectors, folds=4, least=3)
    assert rows_seen == [16, 8, 4, 3]
    assert [n for _, _, n in found] == [1] * 8 + [2] * 4 + [3] * 1 + [4] * 3
    assert max(found, key=lambda x: (x[2], x[1]))[0] == {"x": 15.0}
    rejected = search.pruned(lambda rows, f: rows.select("trial_id", F.lit(float("-inf")).alias("objective")), spark, vectors[:6], folds=2, least=2)
    assert all(x == -math.inf for _, x, _ in rejected)


def test_horizons_follow_the_interval():
    usual = [1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 24]
    assert search.horizons_for(86400, 10_000, usual) == [1, 2, 3, 5, 8, 13, 21, 34, 55]
    assert search.horizons_for(14400, 200, usual) == [1, 2, 3, 4, 6, 8, 12, 16]
    assert search.horizons_for(3600, 100, usual) == [1, 2, 3, 4, 5, 6, 8, 10]
    assert search.horizons_for(None, 5, usual) == [1]
    assert search.horizons_for(3600, 10_000, usual, fast=True) == [1, 3, 5, 8, 12, 16, 20, 24]


def test_the_start_and_the_best_are_measured_again(spark):
    import datetime

    from tickloom.operators import backtest
    from tickloom.sources import bars as source

    lot = np.random.default_rng(4)
    at = datetime.datetime(2024, 1, 1)
    rows = [(s, "1h", at + datetime.timedelta(hours=i), *[float(100 + x)] * 4, 1.0) for s in "AB" for i, x in enumerate(lot.normal(0, 1, 500))]
    bars = source.indexed(spark.createDataFrame(rows, source.BAR_SCHEMA))
    signals = lambda b, t: search.crossing_means(b, t, against=True)
    args = ([1, 3], 2, 5, 20, 40)
    start, best = {"fast": 5.0, "slow": 6.0}, {"fast": 1.0, "slow": 8.0}
    found = {r["which"]: r for r in search.re_evaluated(lambda t: search.trial_metrics(signals, bars, t, *args), spark, start, best).collect()}
    assert (found["best"]["fast"], found["best"]["kept"], found["start"]["kept"]) == (1.0, True, False) and math.isfinite(found["best"]["objective"])
    alone = backtest.roll_up(backtest.fold_metrics(signals(bars, search.trial_rows(spark, [best])), *args), backtest.KEY)
    want = backtest.across_symbols(alone.withColumn("k", F.lit(1)), ["k"]).first()
    for name in ("mcc", "roc_auc", "total_trades", "win_rate", "sharpe", "avg_return", "avg_holding", "consistency"):
        assert found["best"][name] == pytest.approx(want[name])
    same = {r["which"]: r["kept"] for r in search.re_evaluated(lambda t: t.select("trial_id", F.lit(0.5).alias("objective")), spark, start, best).collect()}
    none = {r["which"]: r["kept"] for r in search.re_evaluated(lambda t: t.select("trial_id", F.lit(0.5).alias("objective")).where("false"), spark, start, best).collect()}
    assert same == none == {"start": True, "best": False}
