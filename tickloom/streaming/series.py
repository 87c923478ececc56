"""Series of a stream of bars whose memory is kept between micro-batches, by arbitrary state with
value state, list state and timers. They equal the columns of the same names over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tickloom.operators import fold
from tickloom.operators.affine import Mean

#: The state store that arbitrary state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "symbol string, interval string, timestamp timestamp, value double, held boolean, total double, top double, since long, nth double, is_kept boolean, mean double"
_MEMORY = "bars long, newest long, total double, top double, held_at long, was boolean, kept_at long, mean double, weight double, seen double"
_NONE = -1


class SeriesState(StatefulProcessor):
    """Per series: the sum and the maximum so far, bars since the condition held, the value at its k-th
    latest time, its edges at least `apart` bars apart, and a smoothed mean.

    Within a micro-batch bars are put in time order; one that is not newer than those taken before has
    no place any more and is left out. With `idle` (milliseconds), a series without bars for so long,
    by event time, is forgotten, and starts anew."""

    def __init__(self, n: int, k: int, apart: int, idle: int | None):
        self.mean, self.k, self.apart, self.idle = Mean(1 / n, n), k, apart, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", _MEMORY)
        self.values = handle.getListState("values", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("timestamp", kind="stable").drop_duplicates("timestamp")
        started = self.memory.exists()
        bars, newest, total, top, held_at, was, kept_at, mean, weight, seen = self.memory.get() if started else (0, _NONE, 0.0, np.nan, _NONE, False, _NONE, *Mean.start)
        times = new["timestamp"].to_numpy().astype("datetime64[us]").astype(np.int64)
        if started:
            new, times = new[times > newest], times[times > newest]
        if not len(new):
            return
        x, held = new["value"].to_numpy(dtype=float, na_value=np.nan), new["held"].fillna(False).to_numpy(dtype=bool)
        at = bars + np.arange(len(x))
        totals = total + np.cumsum(np.nan_to_num(x))
        tops = np.fmax.accumulate(np.concatenate([[top], x]))[1:]
        lasts = np.maximum.accumulate(np.concatenate([[held_at], np.where(held, at, _NONE)]))[1:]
        known = [v[0] if v[0] is not None else np.nan for v in self.values.get()] if self.values.exists() else []
        nth = np.full(len(x), np.nan)
        kept = np.zeros(len(x), bool)
        edges = held & ~np.concatenate([[was], held[:-1]])
        for i in range(len(x)):
            if held[i]:
                known = [*known, float(x[i])][-self.k - 1 :]
            if len(known) > self.k:
                nth[i] = known[0]
            if edges[i] and (kept_at == _NONE or at[i] - kept_at >= self.apart):
                kept[i], kept_at = True, int(at[i])
        means = self.mean.run(x, (mean, weight, seen))
        mean, weight, seen = self.mean.pass_on((mean, weight, seen), self.mean.sum_up(x))
        self.memory.update((int(at[-1]) + 1, int(times[-1]), float(totals[-1]), float(tops[-1]), int(lasts[-1]), bool(held[-1]), kept_at, float(mean), float(weight), float(seen)))
        if known:
            self.values.put([(v,) for v in known])
        if self.idle is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(int(times[-1]) // 1000 + self.idle)
        since = pd.array(np.where(lasts == _NONE, 0, at - lasts), "Int64")
        since[lasts == _NONE] = pd.NA
        yield pd.DataFrame({
            "symbol": key[0], "interval": key[1], "timestamp": new["timestamp"].to_numpy(), "value": x, "held": held, "total": totals, "top": tops, "since": since,
            "nth": nth, "is_kept": kept, "mean": means,
        })

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.memory.clear()
        self.values.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_series(stream: DataFrame, value: Column, held: Column, n: int = 14, k: int = 0, apart: int = 7, idle: int | None = None, late: str = "1 hour") -> DataFrame:
    """Columns of OUTPUT for every bar of a stream: of `value` the sum and maximum so far and the mean
    smoothed over n bars; of the condition `held` the bars since, the value k times before, and its
    edges `apart` bars apart. State is kept until a series is idle for `idle` milliseconds of event
    time, or for ever; with idle, bars later than `late` are left out. Sets the session's state store."""
    stream.sparkSession.conf.set(*STATE_STORE)
    bars = stream.select(*fold.KEY, F.col("timestamp").cast("timestamp").alias("timestamp"), value.cast("double").alias("value"), F.coalesce(held, F.lit(False)).alias("held"))
    if idle is not None:
        bars = bars.withWatermark("timestamp", late)
    mode = "none" if idle is None else "eventTime"
    return bars.groupBy(*fold.KEY).transformWithStateInPandas(SeriesState(n, k, apart, idle), OUTPUT, "append", mode)
