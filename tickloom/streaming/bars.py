"""Bars from a stream of ticks: event-time windows with a watermark, written as they close; bars that
arrive twice, and averages that go on from one micro-batch to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators import fold
from tickloom.sources import bars

MEMORY_OF_LATE_TICKS = "1 hour"


def stream_bars(ticks: DataFrame, symbol: Column, time: str, price: Column, size: Column, interval: str, late: str = MEMORY_OF_LATE_TICKS) -> DataFrame:
    """The bars of a streaming tick table, by the same plan as a batch; ticks later than `late` are
    left out, and state is dropped behind the watermark."""
    return bars.ticks_to_bars(ticks.withWatermark(time, late), symbol, F.col(time), price, size, interval)


def append_bars(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed bars to Parquet until the input is used up; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_bars(stream: DataFrame, late: str = MEMORY_OF_LATE_TICKS) -> DataFrame:
    """Each (symbol, interval, timestamp) of a stream of bars once, the first that arrived; state is
    dropped `late` behind the newest bar, and bars later than that are left out."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark([*fold.KEY, "timestamp"])


def stream_ema(stream: DataFrame, column: str, n: int) -> DataFrame:
    """(symbol, interval, timestamp, value, ema) of a stream of bars: the average of the batch
    fold, whose state of three numbers a series is kept between micro-batches. Within a micro-batch
    bars are put in time order; a bar that arrives after a newer one of its series was taken has no
    place in the average and is left out."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values("timestamp", kind="stable").drop_duplicates("timestamp")
        mean, weight, seen, newest = state.get if state.exists else (0.0, 0.0, 0, None)
        if newest is not None:
            rows = rows[rows["timestamp"] > pd.Timestamp(newest)]
        if not len(rows):
            return
        out, held = fold.smooth_on(rows["value"].to_numpy(dtype=float, na_value=np.nan), 2 / (n + 1), n, (mean, weight, seen))
        state.update((*held, rows["timestamp"].iloc[-1].to_pydatetime()))
        yield rows.assign(ema=out)[["symbol", "interval", "timestamp", "value", "ema"]]

    kept = stream.select(*fold.KEY, F.col("timestamp").cast("timestamp").alias("timestamp"), F.col(column).cast("double").alias("value"))
    schema = "symbol string, interval string, timestamp timestamp, value double, ema double"
    return kept.groupBy(*fold.KEY).applyInPandasWithState(run, schema, "mean double, weight double, seen long, newest timestamp", "append", GroupStateTimeout.NoTimeout)
