"""Choice of thresholds and horizons among equal measures, and evaluation in one pass."""

from pyspark.sql import functions as F

from tickloom.operators import backtest

#: Positives and negatives by score. (1, 3) and (2, 8) of 3 and 17 have one MCC, but divided out it
#: differs in its last bit.
TIED = {3.0: (1, 3), 2.0: (1, 5), 1.0: (1, 9)}


def test_equal_measures_choose_the_highest_score(spark):
    rows = [("A", s, label) for s, counts in TIED.items() for label, n in zip((1, 0), counts) for _ in range(n)]
    found = backtest.best_threshold(spark.createDataFrame(rows, "symbol string, score double, label int"), ["symbol"]).first()
    assert found["threshold"] == 3.0


def test_equal_measures_choose_the_highest_score_in_one_pass(spark):
    rows = [("A", "1d", 0, 1, s, p, q, p, q) for s, (p, q) in TIED.items()]
    outcomes = spark.createDataFrame(rows, "symbol string, interval string, fold int, horizon int, score double, p long, q long, up long, down long")
    found = backtest._chosen(outcomes.withColumns({"said": F.lit(0), "right": F.lit(0)}), 1).first()
    assert (found["threshold"], found["tp"], found["fp"]) == (3.0, 1, 3)
