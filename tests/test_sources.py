"""Sources and helpers that no registered query reads."""

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from tickloom.operators import fold, results, search
from tickloom.sources import bars as source


def write(path, rows):
    path.write_text("timestamp,open,high,low,close,volume\n" + "".join(f"{t},{c},{c},{c},{c},{v}\n" for t, c, v in rows))


def test_csv_sets_are_scanned_by_their_names(spark, tmp_path):
    write(tmp_path / "BTCUSDT_1h.csv", [("2024-01-01 00:00:00", 1.5, 2), ("2024-01-01 01:00:00", 2.5, "")])
    write(tmp_path / "ETHUSDT_1h.csv", [("2024-01-01 00:00:00", 3.0, 1)])
    write(tmp_path / "ETHUSDT_1d.csv", [])
    write(tmp_path / "notes.csv", [("2024-01-01 00:00:00", 9, 9)])
    folder = f"file://{tmp_path}"
    got = sorted(tuple(r) for r in source.read_csv_bars(spark, folder).select("symbol", "interval", "timestamp", "close", "volume").collect())
    at = datetime.datetime(2024, 1, 1)
    assert got == [("BTCUSDT", "1h", at, 1.5, 2.0), ("BTCUSDT", "1h", at.replace(hour=1), 2.5, None), ("ETHUSDT", "1h", at, 3.0, 1.0)]
    assert source.read_csv_bars(spark, folder, ["ETHUSDT"]).count() == 1 and source.read_csv_bars(spark, folder, [], ["1d"]).count() == 0
    b = source.read_csv_bars(spark, folder)
    assert source.has_bars(b, "ETHUSDT", "1h") and not source.has_bars(b, "ETHUSDT", "1d")


def test_lists_of_symbols_and_instruments(spark):
    rows = spark.createDataFrame([(" btc, eth btcusdt,,sol ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(source.symbol_list(F.col("t"))).collect()] == [["BTCUSDT", "ETHUSDT", "SOLUSDT"], [], None]
    info = {"symbols": [{"symbol": s, "quoteAsset": q, "status": st, "isSpotTradingAllowed": a} for s, q, st, a in (("BUSDT", "USDT", "TRADING", True), ("AUSDT", "USDT", "TRADING", True), ("CUSDT", "USDT", "BREAK", True), ("DBTC", "BTC", "TRADING", True), ("EUSDT", "USDT", "TRADING", None))]}
    one = spark.createDataFrame([(json.dumps(info),), ("{",)], "t string")
    assert one.select(source.instruments(F.col("t"))).first()[0] == ["AUSDT", "BUSDT"]


def test_results_of_one_context_and_their_words(spark):
    rows = spark.createDataFrame([("A", "1h", 1), ("ALL", "1h", 2), ("A", "4h", 3), ("B", "1h", 4), (None, "1h", 5)], "symbol string, interval string, k int")
    assert sorted(r["k"] for r in results.same_context(rows, "A", "1h").collect()) == [1, 2]
    words = spark.createDataFrame([(0.65, 2.5, 48.0), (0.5, 1.0, 5.0), (0.1, 0.5, 1.0)], "w double, p double, h double")
    got = [r[0] for r in words.select(results.market_text(F.col("w"), F.col("p"), F.col("h"))).collect()]
    assert [g.split(", held")[0] for g in got] == ["high hit rate, strong edge", "balanced hit rate, thin edge", "few large wins, no edge"]


def test_largest_triangles_keep_the_ends_and_the_extremes():
    x = np.arange(1000.0)
    y = np.sin(x / 50)
    y[137], y[642] = 9, -9
    kept = fold.lttb(x, y, 60)
    assert len(kept) == len(set(kept)) == 60 and kept[0] == 0 and kept[-1] == 999 and {137, 642} <= set(kept.tolist()) and (np.diff(kept) > 0).all()
    assert fold.lttb(x[:5], y[:5], 10).tolist() == [0, 1, 2, 3, 4] and fold.lttb(x[:5], y[:5], 2).tolist() == [0, 1, 2, 3, 4]


def test_the_space_of_a_script(spark):
    params = spark.createDataFrame([("n", "n", "int", 5.0, 1.0, 10.0, 4.0), ("ratio", "ratio", "float", 0.5, 0.0, 1.0, 0.25), ("lineWidth", "w", "int", 1.0, 1.0, 3.0, 1.0)], "name string, title string, kind string, default_value double, min_value double, max_value double, step double")
    assert search.space_of(params) == {"n": (1.0, 9.0, 4.0), "ratio": (0.0, 1.0, 0.25)}
