"""Averages whose gain follows the market, Fisher's transform, volume indexes and streaks.

What windows can express is a column of the plan; only the recursion itself is a fold over the
arrays of a series.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import series
from tickloom.operators import fold


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_gains(bars: DataFrame, efficiency: int = 10, fast: int = 2, slow: int = 30, momentum: int = 9, fractal: int = 16) -> DataFrame:
    """bars with the gain (0 to 1) of three adaptive averages of close; missing until a frame is full.

    kama_gain: how straight the path of `efficiency` bars was, between a slow and a fast average;
    vidya_gain: a usual average's gain times the balance of ups and downs; frama_gain: from the
    fractal dimension, which compares the ranges of both halves of a frame with that of the whole."""
    w, half = series.by_series(), fractal // 2
    bars = bars.withColumn("__step", F.col("close") - F.lag("close").over(w))
    step, many, few = F.col("__step"), series.last_rows(efficiency), series.last_rows(momentum)
    straight = _share(F.abs(F.sum(step).over(many)), F.sum(F.abs(step)).over(many))
    low, high = 2 / (slow + 1), 2 / (fast + 1)
    balance = _share(F.abs(F.sum(step).over(few)), F.sum(F.abs(step)).over(few))

    def spread(first: int, last: int) -> Column:
        frame = w.rowsBetween(first, last)
        return (F.max("high").over(frame) - F.min("low").over(frame)) / (last - first + 1)

    both, whole = spread(1 - half, 0) + spread(1 - fractal, -half), spread(1 - fractal, 0)
    dimension = F.when((both > 0) & (whole > 0), F.ln(both / whole) / math.log(2)).otherwise(1.0)
    return bars.withColumns(
        {
            "kama_gain": F.when(F.count(step).over(many) == efficiency, F.pow(straight * (high - low) + low, F.lit(2.0))),
            "vidya_gain": F.when(F.count(step).over(few) == momentum, balance * (2 / (momentum + 1))),
            "frama_gain": F.when(F.count("close").over(series.last_rows(fractal)) == fractal, series.clip(F.exp(-4.6 * (dimension - 1)), 0.01, 1.0)),
        }
    ).drop("__step")


def follow(x: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """An average that moves by its gain towards each value, from the first value with a gain on; a
    missing value or gain leaves it where it is."""
    out, mean = np.full(len(x), np.nan), math.nan
    for i, (v, g) in enumerate(zip(x.tolist(), gain.tolist())):
        if v == v and g == g:
            mean = v if mean != mean else mean + g * (v - mean)
        out[i] = mean
    return out


def mcginley(x: np.ndarray, n: int) -> np.ndarray:
    """Gain 1 / (n * (value / mean) ** 4), one at most: faster down than up."""
    out, mean = np.full(len(x), np.nan), math.nan
    for i, v in enumerate(x.tolist()):
        if v == v:
            if mean != mean or mean <= 0:
                mean = v
            else:
                mean += (v - mean) / max(n * (v / mean) ** 4, 1.0)
        out[i] = mean
    return out


def with_place(bars: DataFrame, n: int = 9) -> DataFrame:
    """bars with `place`: where the middle of the bar lies in the range of n bars, -1 to 1."""
    mid = (F.col("high") + F.col("low")) / 2
    top, bottom = series.highest(mid, n), series.lowest(mid, n)
    return bars.withColumn("place", F.when(top > bottom, 2 * (mid - bottom) / (top - bottom) - 1).otherwise(0.0))


def fisher(place: np.ndarray) -> np.ndarray:
    """Fisher's transform of the smoothed place, itself smoothed by half."""
    out, held, value = np.zeros(len(place)), 0.0, 0.0
    for i, p in enumerate(np.nan_to_num(place).tolist()):
        held = max(-0.999, min(0.999, 0.33 * p + 0.67 * held))
        value = 0.5 * math.log((1 + held) / (1 - held)) + 0.5 * value
        out[i] = value
    return out


def averages(bars: DataFrame) -> DataFrame:
    """bars with kama, vidya, frama and mcginley (14 bars), all in one fold."""
    gained = with_gains(bars)
    names = ("kama", "vidya", "frama")
    return fold.fold(gained, lambda b: {**{n: follow(b["close"], b[f"{n}_gain"]) for n in names}, "mcginley": mcginley(b["close"], 14)}, [*names, "mcginley"])


def with_volume_indexes(bars: DataFrame) -> DataFrame:
    """bars with pvt (volume weighted by the relative change, added up) and the logarithms of the
    indexes that move with close only where volume fell (nvi_log) or rose (pvi_log); windows alone.
    Steps from or to a price of zero or less count as none."""
    w, cum = series.by_series(), series.so_far()
    bars = bars.withColumns({"__was": F.lag("close").over(w), "__vol": F.lag("volume").over(w)})
    sound = (F.col("__was") > 0) & (F.col("close") > 0)
    growth = F.when(sound, F.ln(F.col("close") / F.col("__was")))
    moved = {
        "pvt": F.when(sound, F.col("volume") * (F.col("close") - F.col("__was")) / F.col("__was")),
        "nvi_log": F.when(F.col("volume") < F.col("__vol"), growth),
        "pvi_log": F.when(F.col("volume") > F.col("__vol"), growth),
    }
    return bars.withColumns({n: F.coalesce(F.sum(x).over(cum), F.lit(0.0)) for n, x in moved.items()}).drop("__was", "__vol")


def with_streak(bars: DataFrame) -> DataFrame:
    """bars with `streak`: how many bars in a row close rose (positive) or fell (negative)."""
    w = series.by_series()
    bars = bars.withColumn("__sign", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).cast("long"))
    bars = bars.withColumn("__turn", (F.col("__sign") != F.lag("__sign", 1, 9).over(w)).cast("long"))
    bars = bars.withColumn("__run", F.sum("__turn").over(series.so_far()))
    place = F.row_number().over(Window.partitionBy("symbol", "interval", "__run").orderBy("timestamp"))
    return bars.withColumn("streak", F.col("__sign") * place).drop("__sign", "__turn", "__run")


def with_swings(bars: DataFrame) -> DataFrame:
    """bars with swing, how far close and body moved relative to the larger reach from the close
    before (0 without a bar before), and swings, its sum so far."""
    w = series.by_series()
    was, opened = F.lag("close").over(w), F.lag("open").over(w)
    reach = F.greatest(F.abs(F.col("high") - was), F.abs(F.col("low") - was))
    moved = (F.col("close") - was) + 0.5 * (F.col("close") - F.col("open")) + 0.25 * (was - opened)
    bars = bars.withColumn("swing", F.coalesce(50 * moved / F.when(reach == 0, 1.0).otherwise(reach), F.lit(0.0)))
    return bars.withColumn("swings", F.sum("swing").over(series.so_far()))


def laguerre(x: np.ndarray, gain: float = 0.5) -> np.ndarray:
    """Share of the falls from each of four chained filters to the next, 0 to 1; the filters start
    at zero, and a missing value leaves them where they are."""
    out, stages = np.full(len(x), np.nan), [0.0] * 4
    for i, v in enumerate(x.tolist()):
        if v == v:
            now = [(1 - gain) * v + gain * stages[0]]
            for k in range(1, 4):
                now.append(stages[k - 1] + gain * (stages[k] - now[k - 1]))
            stages = now
        steps = [a - b for a, b in zip(stages, stages[1:])]
        total = sum(map(abs, steps))
        out[i] = sum(s for s in steps if s > 0) / total if total else 0.0
    return out
