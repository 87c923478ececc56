import math
import os

from pyspark.sql import functions as F

from tickloom.operators import fold
from tickloom.sources import bars
from tickloom.streaming.bars import append_bars, stream_bars, stream_ema, unique_bars


def parted(spark, sf_dir, tmp_path):
    """Batch bars, and a stream that reads them in three files, each one micro-batch, in time order."""
    batch = bars.event_bars(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    days, seen = F.dayofmonth("timestamp"), set()
    for k, part in enumerate((days <= 10, (days > 10) & (days <= 20), days > 20)):
        batch.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for at in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(at, (1e9 + 10 * k, 1e9 + 10 * k))
            seen.add(at)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_average_equals_batch_average(spark, sf_dir, tmp_path):
    batch, stream = parted(spark, sf_dir, tmp_path)
    append_bars(stream_ema(stream, "close", 12), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(200)
    got = {(r.symbol, r.timestamp): r.ema for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.symbol, r.timestamp): r.ema for r in fold.fold(batch, lambda b: {"ema": fold.ema(b["close"], 12)}, ["ema"]).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (v is None and (got[k] is None or math.isnan(got[k]))) or abs(got[k] - v) < 1e-9


def test_bars_that_arrive_twice_stay_once(spark, sf_dir, tmp_path):
    batch, _ = parted(spark, sf_dir, tmp_path)
    batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    append_bars(unique_bars(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(200)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_streamed_bars_equal_batch_bars(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    stream = stream_bars(ticks, F.col("event_type"), "ts", F.col("value"), F.lit(1.0), "4h")
    append_bars(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = bars.ticks_to_bars(spark.read.parquet(f"{tmp_path}/in"), F.col("event_type"), F.col("ts"), F.col("value"), F.lit(1.0), "4h")
    want = {tuple(r) for r in batch.collect()}
    assert got and got <= want
    last = max(r[2] for r in want)
    assert all((last - r[2]).total_seconds() <= 2 * 4 * 3600 for r in want - got)  # only the newest bars are still open
