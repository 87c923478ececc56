import datetime
import math

from pyspark.sql import functions as F

from tickloom.operators import backtest, indicators, matrix
from tickloom.sources import bars as source

STORED = "script string, symbol string, interval string, kind string, length int, bars long, buys long, sells long, mean_signal double"


def bars(spark, n=160):
    start = datetime.datetime(2024, 1, 1)
    rows = [(s, "1h", start + datetime.timedelta(hours=i), *[100 + k * math.sin(i / (3 + k)) + i % 7] * 4, 1.0 + i % 5) for k, s in enumerate("ABC", 2) for i in range(n)]
    return source.indexed(spark.createDataFrame(rows, source.BAR_SCHEMA))


def scripts(spark):
    texts = {"one": "x = ta.rsi(close)", "two": "length = input.int(9)\nx = ta.rsi(close, length)", "My Money Flow": "", "Some MACD": "", "rest": "plot(close)", "also": "plot(open)", "empty": None}
    return spark.createDataFrame(list(texts.items()), "script string, body string")


def counting(seen):
    def measure(signals):
        rows = matrix.signal_counts(signals).cache()
        seen.append(sorted((r["symbol"], *r["interval"].split("#")[1:]) for r in rows.collect()))
        return rows

    return measure


def test_scripts_go_to_their_evaluators(spark):
    got = {r["script"]: (r["kind"], r["length"]) for r in matrix.routed(scripts(spark)).collect()}
    assert got == {"one": ("rsi", 14), "two": ("rsi", 9), "My Money Flow": ("money_flow", 0), "Some MACD": ("macd", 0), "rest": ("roc", 14), "also": ("roc", 14), "empty": ("roc", 14)}


def test_a_second_run_computes_what_is_absent(spark, tmp_path):
    b, every, seen = bars(spark), scripts(spark), []
    store = matrix.ResultStore(spark, f"{tmp_path}/store", STORED, ["script", *matrix.KEY])
    assert store.rows().count() == 0
    first = matrix.extend(store, b, every.where("script IN ('one', 'rest')"), counting(seen), b.where("symbol = 'A'"))
    assert first.count() == 2 and seen.pop() == [("A", "roc", "14"), ("A", "rsi", "14")]
    assert matrix.extend(store, b, every, counting(seen)).count() == 21
    both = [(s, k, n) for s in "ABC" for k, n in (("macd", "0"), ("money_flow", "0"), ("roc", "14"), ("rsi", "9"), ("rsi", "14"))]
    assert seen.pop() == sorted(set(both) - {("A", "rsi", "14")})  # A's roc is wanted by the two scripts that lack it
    matrix.extend(store, b, every, counting(seen))
    assert not seen and len(store._runs()) == 2
    direct = matrix.signal_counts(indicators.directional(indicators.generic(b, "rsi", 9)))
    kept = store.rows().where("script = 'two'").select("symbol", "bars", "buys", "sells").collect()
    assert sorted(map(tuple, kept)) == sorted((r.symbol, r.bars, r.buys, r.sells) for r in direct.collect())


def test_the_latest_run_of_a_key_holds(spark, tmp_path):
    store = matrix.ResultStore(spark, f"{tmp_path}/store", "k string, x int", ["k"])
    for rows in ([("a", 1), ("b", 1)], [("b", 2), ("b", 3)], [("c", 4)]):
        store.append(spark.createDataFrame(rows, "k string, x int"))
    want = [("a", 1), ("b", 2), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, store.rows().collect())) == want
    (tmp_path / "store" / "run=9").mkdir()  # a run that was not committed
    store.compact()
    assert sorted(map(tuple, store.rows().collect())) == want and store._runs() == [0, 1, 2, 10]


def test_walk_forward_of_the_matrix_equals_one_script_at_a_time(spark):
    b = bars(spark, 300)
    wanted = matrix.combinations(scripts(spark).where("script IN ('one', 'also')"), b)
    measure = matrix.walk_forward([1, 3], 2, 5, 20, 30)
    got = {(r["script"], r["symbol"]): (r["tp"], r["fp"], r["tn"], r["fn"], r["total_trades"]) for r in matrix.measured(b, wanted, measure).collect()}
    for name, kind in (("one", "rsi"), ("also", "roc")):
        alone = backtest.roll_up(backtest.fold_metrics(indicators.directional(indicators.generic(b, kind)), [1, 3], 2, 5, 20, 30), matrix.KEY)
        for r in alone.collect():
            assert got.pop((name, r["symbol"])) == (r["tp"], r["fp"], r["tn"], r["fn"], r["total_trades"])
    assert not got


def test_nothing_wanted(spark):
    b = bars(spark, 20)
    assert matrix.measured(b, matrix.combinations(scripts(spark).where(F.lit(False)), b), matrix.signal_counts).count() == 0
