"""Daily bars dealt by series: one exchange of the ticks, and the measures made where a series lies."""

import re

import pytest

from tickloom.operators import backtest, search
from tickloom.plans import registry
from tickloom.sources import bars as source

from .test_search import bars


def exchanges(df):
    """Hash exchanges of the plan, by their arguments."""
    return re.findall(r"Exchange hashpartitioning\(([^()]*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["a07_daily_labels", "a20_daily_walk_forward"])
def test_one_exchange_carries_a_series(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(source, "TASK_TICKS", 500, raising=False)
    assert len(exchanges(registry.queries()[name](spark, sf_dir))) == 1


def test_tasks_grow_with_the_ticks(spark, sf_dir, monkeypatch):
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(source, "TASK_TICKS", 500)
    dealt = source.lineitem_bars(spark, sf_dir, by_series=True)
    assert dealt.rdd.getNumPartitions() == 1 + n // 500
    assert dealt.exceptAll(source.lineitem_bars(spark, sf_dir)).count() == 0


def test_counts_and_area_against_pairs(spark):
    found = {k: [((i * 7 + k) % 5 - 2.0, int(i * i % 3 == k % 3)) for i in range(11)] for k in (1, 2, 3)} | {4: [(1.0, 1), (-1.0, 1)]}
    rows = spark.createDataFrame([(k, s, y) for k, v in found.items() for s, y in v], "k int, score double, label int")
    for r in backtest.scored_counts(rows, ["k"]).collect():
        v = found[r["k"]]
        want = [sum(y == a and (s >= 0) == b for s, y in v) for a, b in ((1, True), (0, True), (0, False), (1, False))]
        assert [r[c] for c in ("tp", "fp", "tn", "fn")] == want
        pairs = [(s > t) + (s == t) / 2 for s, y in v if y for t, z in v if not z]
        assert r["roc_auc"] == pytest.approx(sum(pairs) / len(pairs) if pairs else 0.5)


def test_trials_average_where_a_series_lies(spark):
    """No exchange of the bars by their number, and the averages by brute force."""
    one = bars(spark, 80)
    made = search.with_means(one, search.trial_rows(spark, [{"fast": 2.0, "slow": 5.0}, {"fast": 5.0, "slow": 60.0}]))
    assert not any("bar_index" in x or "__to" in x for x in exchanges(made))
    close = {(r["symbol"], r["bar_index"]): r["close"] for r in one.collect()}
    rows = made.collect()
    assert len(rows) == 2 * len(close)
    for r in rows:
        for name in ("fast", "slow"):
            n, i = int(r[name]), r["bar_index"]
            want = sum(close[r["symbol"], k] for k in range(i - n + 1, i + 1)) / n if i >= n - 1 else None
            assert r[f"{name}_mean"] == (want if want is None else pytest.approx(want))
