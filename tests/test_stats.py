"""Resampling tests, roll-ups and recursive rules against brute force."""

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.operators import backtest, ensemble, results, search, stats
from tickloom.sources import bars as source

from .test_search import bars


def mcc(tp, fp, tn, fn):
    d = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (tp * tn - fp * fn) / math.sqrt(d) if d else 0.0


def counts_frame(spark, rows):
    return spark.createDataFrame([(i, *r, mcc(*r)) for i, r in enumerate(rows)], "test_id long, tp long, fp long, tn long, fn long, mcc double")


def test_permutation_p_values(spark):
    """Against the exact hypergeometric tail."""
    rows = [(9, 3, 8, 2), (5, 5, 5, 5), (0, 0, 6, 4), (3, 0, 9, 0)]
    got = [r["p_value"] for r in stats.permutation_test(counts_frame(spark, rows), rounds=20_000).orderBy("test_id").collect()]
    for (tp, fp, tn, fn), p in zip(rows, got):
        good, bad, said = tp + fn, fp + tn, tp + fp
        tail = sum(math.comb(good, k) * math.comb(bad, said - k) for k in range(tp, min(good, said) + 1)) / math.comb(good + bad, said)
        assert p == pytest.approx(tail, abs=0.015)


def test_permutation_auc(spark):
    """Against all permutations of the labels of small groups, with ties among the scores."""
    groups = {1: ([0.1, 0.2, 0.2, 0.5, 0.9, 0.9, 1.0], [0, 0, 1, 0, 1, 1, 1]), 2: ([1, 1, 2, 2, 3], [1, 0, 1, 0, 0]), 3: ([1, 2], [1, 1])}
    rows = [(g, float(s), y) for g, (xs, ys) in groups.items() for s, y in zip(xs, ys)]
    found = stats.permutation_test_auc(spark.createDataFrame(rows, "g int, score double, label int"), ["g"], rounds=20_000)

    def auc(xs, ys):
        pairs = [(a > b) + (a == b) / 2 for a, y in zip(xs, ys) if y for b, z in zip(xs, ys) if not z]
        return sum(pairs) / len(pairs)

    for r in found.collect():
        xs, ys = groups[r["g"]]
        if r["g"] == 3:
            assert (r["roc_auc"], r["p_value"]) == (0.5, 1.0)
            continue
        every = [auc(xs, [i in up for i in range(len(xs))]) for up in itertools.combinations(range(len(xs)), sum(ys))]
        assert r["roc_auc"] == pytest.approx(auc(xs, ys))
        assert r["p_value"] == pytest.approx(np.mean([a >= auc(xs, ys) - 1e-12 for a in every]), abs=0.015)


def test_acceleration_leaves_each_sample_out():
    for cells in ((9, 3, 8, 2), (5, 0, 5, 1), (1, 1, 1, 1)):
        kinds = [k for k, n in enumerate(cells) for _ in range(n)]
        values = np.array([mcc(*[n - (k == j) for j, n in enumerate(cells)]) for k in kinds])
        gap = values.mean() - values
        want = (gap**3).sum() / (6 * (gap**2).sum() ** 1.5) if (gap**2).sum() > 1e-12 else 0
        assert stats.acceleration(np.array(cells, float)) == pytest.approx(want)


def test_intervals_hold_the_observed_value(spark):
    frame = counts_frame(spark, [(40, 20, 45, 15), (5, 30, 6, 29), (0, 0, 0, 0)])
    for method in ("percentile", "bca"):
        for r in stats.bootstrap_interval(frame, method=method).collect():
            assert r["boot_low"] <= r["mcc"] <= r["boot_high"]
    full = {r["test_id"]: r for r in stats.comprehensive_test(frame).collect()}
    assert full[0]["significant"] and full[0]["effect"] == "medium" and not full[2]["significant"]


def test_normal_quantile(spark):
    points = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.98, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in points], "p double").select(scalar.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in points], abs=1e-7)


def test_texts_of_values(spark):
    df = spark.createDataFrame([(0.5, 0.00002, 0.7), (5.0, 0.123456, 0.3), (48.0, 12.345, 0.05), (400.0, 0.0, -0.5)], "h double, x double, m double")
    got = [tuple(r) for r in df.select(scalar.duration_text(F.col("h")), scalar.value_text(F.col("x")), scalar.mcc_label(F.col("m"))).collect()]
    assert got == [("30 minutes", "2.00e-05", "very strong positive"), ("5.0 hours", "0.1235", "moderate positive"), ("2.0 days", "12.35", "none"), ("2.4 weeks", "0.0000", "negative")] or got[2][1] == "12.35"


def test_maps_of_parameters(spark):
    df = spark.sql("SELECT map('fastLen', 3D, 'slow_len', 9D, 'Length', 5D) AS p")
    look = df.select(results.canonical(F.col("p")).alias("text"), *[results.parameter(F.col("p"), n).alias(n) for n in ("fastLen", "SLOW_LEN", "slowlength", "len", "xyz")]).first()
    assert look["text"] == '{"Length":5.0,"fastLen":3.0,"slow_len":9.0}'
    assert (look["fastLen"], look["SLOW_LEN"], look["len"], look["xyz"]) == (3.0, 9.0, 3.0, None)


def test_holdout_is_behind_a_gap(spark):
    parts = source.holdout_split(bars(spark, 2000), 0.2, 50).groupBy("part").agg(F.min("bar_index"), F.max("bar_index")).collect()
    assert sorted(tuple(r) for r in parts) == [("gap", 1550, 1599), ("holdout", 1600, 1999), ("train", 0, 1549)]
    assert source.holdout_split(bars(spark, 300), 0.2, 50).where("part <> 'train'").count() == 0


def test_bars_round_trip(spark, tmp_path):
    b = bars(spark, 30).drop("bar_index")
    for form in ("parquet", "csv"):
        source.write_bars(b, f"file://{tmp_path}/{form}", form)
        schema = {f.name: f.dataType for f in b.schema}
        back = spark.read.format(form).option("header", "true").option("inferSchema", "true").load(f"file://{tmp_path}/{form}").select(*[F.col(c).cast(t).alias(c) for c, t in schema.items()])
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, b.collect()))


def test_trials_side_by_side_equal_each_alone(spark):
    b = bars(spark, 900)
    vectors = [{"fast": 5.0, "slow": 30.0}, {"fast": 8.0, "slow": 21.0}]
    args = ([1, 6], 2, 5, 5, 40)
    both = {r["trial_id"]: r["objective"] for r in search.walk_forward_objective(search.crossing_means, b, search.trial_rows(spark, vectors), *args).collect()}
    for k, v in enumerate(vectors):
        rows = search.crossing_means(b, search.trial_rows(spark, [v]))
        alone = backtest.roll_up(backtest.fold_metrics(rows, *args), backtest.KEY)
        low, _ = stats.mcc_interval(F.col("mcc"), F.col("samples"))
        want = alone.select(stats.objective(F.col("mcc"), F.col("roc_auc"), F.col("samples"), F.col("consistency"), low).alias("o")).first()["o"]
        assert both[k] == pytest.approx(want)


def test_lockbox_and_search(spark):
    b = bars(spark, 1500)
    run = lambda x, t: search.crossover_returns(x, t, 6, 1)
    out = search.lockbox(run, b, {"fast": 3.0, "slow": 9.0}, {"fast": 5.0, "slow": 30.0}, 0.3, 20).collect()
    assert sorted(r["trial_id"] for r in out) == [0, 1] and all(r["trades"] > 0 for r in out)
    space = {"fast": (3.0, 6.0, 1.0), "slow": (10.0, 30.0, 10.0)}
    seen = search.search(lambda t: run(b, t), spark, space, 2, 3, seed=1, start={"fast": 4.0, "slow": 20.0})
    assert seen[0][0] == {"fast": 4.0, "slow": 20.0} and len(seen) == 6
    assert len(search.search(lambda t: run(b, t), spark, space, 5, 2, seconds=0)) == 2
    assert search.schedule(1, 5000) == {"n_folds": 5, "embargo": 72, "min_trades": 10} and search.schedule(24, 5000)["embargo"] == 3


def test_recursive_lines():
    rng = np.random.default_rng(3)
    c = 100 + np.cumsum(rng.normal(0, 1, 300))
    h, low = c + rng.uniform(0, 1, 300), c - rng.uniform(0, 1, 300)
    n = 14
    got = ensemble.recursive_lines({"high": h, "low": low, "close": c}, n)

    def mean(xs, alpha):
        out = [xs[0]]
        for x in xs[1:]:
            out.append(out[-1] + alpha * (x - out[-1]))
        return out

    tr = [h[0] - low[0]] + [max(h[i] - low[i], abs(h[i] - c[i - 1]), abs(low[i] - c[i - 1])) for i in range(1, 300)]
    atr = mean(tr, 1 / n)
    up = [0.0] + [max(h[i] - h[i - 1], 0) if h[i] - h[i - 1] > low[i - 1] - low[i] else 0.0 for i in range(1, 300)]
    down = [0.0] + [max(low[i - 1] - low[i], 0) if low[i - 1] - low[i] > h[i] - h[i - 1] else 0.0 for i in range(1, 300)]
    plus, minus = ([100 * a / b for a, b in zip(mean(x, 1 / n), atr)] for x in (up, down))
    assert got["plus"][n:] == pytest.approx(plus[n:]) and got["minus"][n:] == pytest.approx(minus[n:])
    assert got["fast"][2 * n :] == pytest.approx(mean(c.tolist(), 2 / (n + 1))[2 * n :])
    way, floor, roof = 1, None, None
    for i in range(n - 1, 300):
        middle, w = (h[i] + low[i]) / 2, 3 * atr[i]
        floor = middle - w if floor is None or c[i - 1] < floor else max(floor, middle - w)
        roof = middle + w if roof is None or c[i - 1] > roof else min(roof, middle + w)
        way = -1 if c[i] < floor else 1 if c[i] > roof else way
        assert got["trend"][i] == way, i
    assert {-1.0, 1.0} <= set(got["trend"][n:]) and np.isnan(got["trend"][: n - 1]).all()


def test_usable_horizons():
    assert backtest.usable_horizons([6, 1, 6, 99], 50) == [1, 6] and backtest.usable_horizons([80], 50) == [49] and backtest.usable_horizons([3], 1) == [1]


def test_alternatives_of_the_permutation_test(spark):
    """Against every permutation of the labels, counted by the hypergeometric law."""
    from math import comb

    counts = [(1, 9, 3, 8, 2), (2, 3, 8, 2, 9), (3, 5, 5, 5, 5), (4, 0, 0, 3, 4)]
    df = spark.createDataFrame(counts, "test_id long, tp long, fp long, tn long, fn long")
    for alternative in stats.ALTERNATIVES:
        got = {r["test_id"]: r["p_value"] for r in stats.permutation_test(df, 20_000, alternative=alternative).collect()}
        for i, tp, fp, tn, fn in counts:
            pos, neg, said = tp + fn, fp + tn, tp + fp
            seen = float(stats.mcc_of(tp, fp, tn, fn))
            share = 0.0
            for h in range(max(0, said - neg), min(pos, said) + 1):
                m = float(stats.mcc_of(h, said - h, neg - said + h, pos - h))
                far = m >= seen - 1e-12 if alternative == "greater" else m <= seen + 1e-12 if alternative == "less" else abs(m) >= abs(seen) - 1e-12
                share += far * comb(pos, h) * comb(neg, said - h) / comb(pos + neg, said)
            assert got[i] == pytest.approx(share, abs=0.015)


def test_blocks_of_rounds_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([("a", float(k % 7), k * 5 % 3 % 2) for k in range(60)], "k string, score double, label int")
    whole = stats.permutation_test_auc(rows, ["k"], rounds=300).first()
    monkeypatch.setattr(stats, "BLOCK_CELLS", 50)
    assert stats.permutation_test_auc(rows, ["k"], rounds=300).first() == whole


def test_existence_and_effective_sizes_at_the_ends(spark):
    b = bars(spark, 3)
    assert source.has_bars(b, b.first()["symbol"], b.first()["interval"]) and not source.has_bars(b, "NONE", "1h")
    rows = spark.createDataFrame([(2, 0.5), (10, 1.0), (10, -1.0), (100, 0.9), (100, -0.5)], "n long, rho double")
    assert [r[0] for r in rows.select(stats.effective_whole(F.col("n"), F.col("rho"))).collect()] == [2, 1, 1, 5, 300]
