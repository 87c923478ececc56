import datetime
import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import asof, audit, fold, subsets

START = datetime.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else START + datetime.timedelta(hours=hours)


def test_as_of_equals_brute_force_over_spans_ties_and_nulls(spark):
    lot = random.Random(4)
    left = [(lot.choice(["a", "b", "c", None]), lot.choice([None, *range(60)]), k) for k in range(150)]
    right = [(lot.choice(["a", "b", None]), lot.choice([None, *range(60)]), lot.choice([None, 1.0, 2.0, 3.0]), k % 3) for k in range(80)]
    one = spark.createDataFrame([(k, at(t), n) for k, t, n in left], "k string, t timestamp_ntz, n int")
    two = spark.createDataFrame([(k, at(t), x, y) for k, t, x, y in right], "k string, u timestamp_ntz, x double, y int")
    want = []
    for k, t, n in left:
        known = [(u, x is not None, x or 0, y) for kk, u, x, y in right if kk == k is not None and u is not None and t is not None and u <= t]
        best = max(known) if known else (None, False, None, None)
        want.append((k, at(t), n, best[2] if best[1] else None, best[3]))
    for hours in (5, 24 * 90):
        got = [tuple(r) for r in asof.as_of(one, two, ["k"], "t", "u", ["x", "y"], hours * 3600).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert asof.as_of(one.limit(0), two, ["k"], "t", "u", ["x"]).count() == 0
    assert {r["x"] for r in asof.as_of(one, two.limit(0), ["k"], "t", "u", ["x"]).collect()} == {None}


def test_nothing_is_seen_ahead(spark):
    schema = "symbol string, interval string, timestamp timestamp_ntz, close double"
    hours = spark.createDataFrame([("A", "1h", at(h), float(h)) for h in range(10)], schema)
    fours = spark.createDataFrame([("A", "4h", at(h), 100.0 + h) for h in (0, 4, 8)], schema)
    got = {r.close: r.four for r in asof.security(hours, fours, None, {"four": "close"}).collect()}
    assert got == {h: (None if h < 3 else 100.0 if h < 7 else 104.0) for h in range(10)}


def test_every_overlapping_pair_is_reported(spark):
    schema = "symbol string, interval string, fold int, train_start long, train_end long, test_start long, test_end long"
    tests = {0: (10, 100), 1: (20, 30), 2: (30, 40), 3: (35, 50), 4: (100, 110)}
    rows = spark.createDataFrame([("A", "1h", f, 0, 5, a, b) for f, (a, b) in tests.items()] + [("B", "1h", 0, 0, 50, 60, 70)], schema)
    got = {(r.fold, r.other, r.bars) for r in audit.overlaps(rows).collect()}
    assert got == {(0, 1, 10), (0, 2, 10), (0, 3, 15), (2, 3, 5)}
    bars = spark.createDataFrame([(s, "1h", at(i), i, 1.0) for s in "ABC" for i in range(120)], "symbol string, interval string, timestamp timestamp_ntz, bar_index long, close double")
    found = {r.symbol: r for r in audit.audit(bars, rows).collect()}
    assert found["A"].overlap_pairs == 4 and "test parts overlap" in found["A"].issues
    assert found["B"].issues == ["the embargo is under two horizons", "the embargo is very short", "many bars are unused"] and found["B"].unused_bars == 50
    assert found["C"].folds == 0 and found["C"].unused_bars == 120


def test_stop_and_reverse_of_short_series():
    assert np.isnan(fold.stop_and_reverse(*[np.array([1.0])] * 3)).all() and len(fold.stop_and_reverse(*[np.zeros(0)] * 3)) == 0


def test_weighed_votes_equal_brute_force(spark):
    lot = random.Random(2)
    names = list("abcdefgh")
    bars = [("S", "1h", at(i), i, 100 + 5 * lot.random()) for i in range(80)]
    votes = [("S", "1h", at(i), i, m, lot.random() < 0.5, lot.random() < 0.4) for i in range(80) for m in [*names, "other"]]
    schema = "symbol string, interval string, timestamp timestamp_ntz, bar_index long, "
    found = subsets.patterns(subsets.member_bits(spark.createDataFrame(votes, schema + "member string, buy boolean, sell boolean"), names), spark.createDataFrame(bars, schema + "close double"), 4)
    weights = [[lot.random() for _ in names] for _ in range(4)]
    trials = [(1000 * w + s, s, weights[w]) for w in range(4) for s in range(1, 256)]
    buy, sell = ({(v[3], v[4]): v[k] for v in votes} for k in (5, 6))
    moves = [(bars[i + 4][4] - bars[i][4]) / bars[i][4] * 100 for i in range(76)]

    def brute(subset, weight, rule):
        own = [(k, m) for k, m in enumerate(names) if subset >> k & 1]
        total = sum(weight[k] for k, _ in own)
        counts, gain = [0, 0, 0, 0], 0.0
        for i, r in enumerate(moves):
            ratios = [sum(weight[k] for k, m in own if side[i, m]) / total for side in (buy, sell)]
            b, s = (x > 0.5 if rule == "majority" else x >= 1 - 1e-12 if rule == "unanimous" else x >= 0.6 for x in ratios)
            if b != s:
                counts[(0 if r > 0 else 1) if b else (2 if r < 0 else 3)] += 1
                gain += r if b else -r
        return (*counts, round(gain, 6))

    for rule, weighed in product(("majority", "weighted"), (False, True)):
        rows = spark.createDataFrame(trials, "trial_id long, subset long, weights array<double>")
        rows = rows if weighed else rows.where("trial_id < 256").drop("weights")
        got = {r.trial_id: (r.tp, r.fp, r.tn, r.fn, round(r.total_return, 6)) for r in subsets.scored(found, rows, rule, 0.6, 8).collect()}
        assert got == {t: brute(s, w if weighed else [1.0] * 8, rule) for t, s, w in trials if weighed or t < 256}
    scores = subsets.scored(found, subsets.every_subset(spark, 8), n=8)
    best = subsets.best_subsets(scores, subsets.KEY).first()
    assert best.mcc == max(r.mcc for r in scores.collect() if r.signals >= 10)
