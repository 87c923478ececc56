import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import adaptive, script, search


def bars(spark, n):
    start = datetime.datetime(2024, 1, 1)
    rows = [("A", "1h", start + datetime.timedelta(hours=i), i, *[100 + 9 * math.sin(i / 60)] * 4, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp_ntz, bar_index long, open double, high double, low double, close double, volume double")


def test_every_trial_is_made(spark):
    trials = spark.range(5000).withColumnRenamed("id", "trial_id")
    assert search.fan_out(bars(spark, 2), trials).count() == 10_000


def test_long_averages_trade(spark):
    trials = search.trial_rows(spark, [{"fast": 5.0, "slow": 250.0}])
    assert search.crossover_returns(bars(spark, 2500), trials, min_trades=1).first()["trades"] > 0


def test_two_stages_start_the_second_from_the_best_of_the_first(spark):
    space = {"x": (0.0, 50.0, 1.0)}
    two = bars(spark, 20).unionAll(bars(spark, 20).withColumn("symbol", F.lit("B")))
    widths = []

    def evaluate(some, trials, how):
        widths.append((some.select("symbol").distinct().count(), how["n_folds"]))
        return trials.select("trial_id", (-F.abs(F.col("x") - 31)).alias("objective"))

    coarse, fine = search.two_stages(evaluate, two, space, 4, 10, {"n_folds": 5}, sampler="random", patience=9)
    assert widths == [(1, 2)] * 2 + [(2, 5)] * 2
    assert len(coarse) == len(fine) == 20 and fine[0] == max(coarse, key=lambda t: t[1])
    assert len({v["x"] for v, _ in coarse + fine}) == 39  # the best alone is tried twice
    assert all(y == -abs(v["x"] - 31) for v, y in coarse + fine)


def test_the_start_stays_unless_the_best_is_better(spark):
    def evaluate(trials):
        return trials.select("trial_id", F.when(F.col("x") == 3, 0.5).otherwise(F.when(F.col("x") == 4, 0.7).otherwise(0.5)).alias("objective"))

    assert search.settled(evaluate, spark, {"x": 3.0}, {"x": 4.0}) == ({"x": 4.0}, 0.5, 0.7)
    assert search.settled(evaluate, spark, {"x": 3.0}, {"x": 9.0}) == ({"x": 3.0}, 0.5, 0.5)
    assert search.settled(lambda t: evaluate(t).where("false"), spark, {"x": 3.0}, {"x": 4.0}) == ({"x": 3.0}, -math.inf, -math.inf)


def test_scripts_without_version_or_values(spark):
    rows = spark.createDataFrame([("a", "indicator(title='T')\nn = input.int(defval=5)"), ("b", None)], "script string, body string")
    got = dict(rows.select("script", script.optimised(F.col("body"), F.create_map(F.lit("n"), F.lit(7.0)), F.lit("// h"))).collect())
    assert got == {"a": "// h\nindicator(title='Optimised T')\nn = input.int(defval=7)", "b": None}
    kept = rows.select("script", script.optimised(F.col("body"), F.lit(None).cast("map<string,double>"), F.lit("// h"))).first()[1]
    assert kept == "// h\nindicator(title='Optimised T')\nn = input.int(defval=5)"


def test_chained_filters_leave_out_missing_values():
    x = np.array([1.0, 2, np.nan, 3, 2, 1])
    got = adaptive.laguerre(x)
    assert got[2] == got[1] and np.allclose(np.delete(got, 2), adaptive.laguerre(np.delete(x, 2))) and (got >= 0).all() and (got <= 1).all()
