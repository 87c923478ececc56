import datetime
import math
import os

from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import fold
from tickloom.sources import bars as source
from tickloom.streaming.bars import append_bars
from tickloom.streaming.series import stream_series

COLUMNS = ("total", "top", "since", "nth", "is_kept", "mean")


def feed(batch, folder, at):
    """One more file, with a time of its own so that files are read in order."""
    before = set(folder.glob("*.parquet")) if folder.exists() else set()
    batch.coalesce(1).write.mode("append").parquet(str(folder))
    for new in set(folder.glob("*.parquet")) - before:
        os.utime(new, (at, at))


def stream_of(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def expected(batch, k, apart):
    x, held = F.col("close"), F.coalesce(F.col("close") > F.col("open"), F.lit(False))
    df = source.indexed(batch).withColumn("held", held).withColumn("edge", series.edge(held).cast("int"))
    df = series.with_value_when(df, F.col("held"), x, k, "nth")
    df = df.withColumns({"total": series.cum(x), "top": F.max(x).over(series.so_far()), "since": series.bars_since(F.col("held"))})
    df = fold.fold(df, lambda b: {"is_kept": fold.cooldown(b["edge"] == 1, apart), "mean": fold.rma(b["close"], 14)}, ["is_kept", "mean"])
    return {(r.symbol, r.timestamp): [r[c] for c in COLUMNS] for r in df.collect()}


def alike(a, b):
    if a is None or b is None or isinstance(a, bool):
        return a == b
    return abs(a - b) < 1e-9 * max(1, abs(b))


def test_stream_equals_batch_over_micro_batches_and_a_restart(spark, sf_dir, tmp_path):
    batch = source.event_bars(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    batch = batch.withColumn("close", F.when(F.pmod(F.hash("timestamp", "symbol"), F.lit(7)) > 0, F.col("close"))).persist()
    days = F.dayofmonth("timestamp")
    folder = tmp_path / "in"
    stream = lambda: stream_series(stream_of(spark, batch.schema, folder), F.col("close"), F.col("close") > F.col("open"), 14, 2, 5)
    for k, part in enumerate((days <= 10, (days > 10) & (days <= 20))):
        feed(batch.where(part), folder, 1e9 + 10 * k)
    append_bars(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
    feed(batch.where(days > 20), folder, 2e9)
    feed(batch.where(days == 15), folder, 2e9 + 10)  # bars that came before: left out
    append_bars(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    got = {(r.symbol, r.timestamp): [None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in COLUMNS] for r in rows}
    want = expected(batch, 2, 5)
    assert len(rows) == len(got) and got.keys() == want.keys()
    for key, values in want.items():
        assert all(alike(a, b) for a, b in zip(got[key], values)), (key, got[key], values)


def test_an_idle_series_is_forgotten(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)

    def bars(symbol, hours):
        rows = [(symbol, "1h", start + datetime.timedelta(hours=h), 1.0, 2.0) for h in hours]
        return spark.createDataFrame(rows, "symbol string, interval string, timestamp timestamp, open double, close double")

    folder = tmp_path / "in"
    feed(bars("A", range(5)).unionAll(bars("B", range(5))), folder, 1e9)
    feed(bars("B", range(5, 60)), folder, 1e9 + 10)
    feed(bars("B", range(60, 62)), folder, 1e9 + 20)
    feed(bars("A", range(62, 64)).unionAll(bars("B", range(62, 64))), folder, 1e9 + 30)
    stream = stream_series(stream_of(spark, bars("A", []).schema, folder), F.col("close"), F.lit(True), 2, idle=24 * 3_600_000)
    append_bars(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(300)
    got = {(r.symbol, int((r.timestamp - start).total_seconds() // 3600)): r.total for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["B", 63] == 128.0 and got["A", 4] == 10.0
    assert got["A", 62] == 2.0  # a new start
