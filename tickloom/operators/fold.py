"""Recursive series: a fold over each series in time order, by Arrow groups.

All recursive columns of a plan are computed in one pass, each as a small step over NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

KEY = ["symbol", "interval"]


def smooth_on(x: np.ndarray, alpha: float, n: int, state: tuple[float, float, int] = (0.0, 0.0, 0)) -> tuple[np.ndarray, tuple[float, float, int]]:
    """Exponential mean seeded by the first value. A gap lets the old mean fade: its weight shrinks
    by 1 - alpha with each row. Missing until n values were seen; later gaps carry the mean on.
    With the state (mean, weight, values seen) after the last row, from which it can go on."""
    out = np.full(len(x), np.nan)
    mean, weight, seen = state
    for i, v in enumerate(x.tolist()):
        weight *= 1 - alpha
        if v == v:
            mean = v if not seen else (weight * mean + alpha * v) / (weight + alpha)
            weight, seen = 1.0, seen + 1
        if seen >= n:
            out[i] = mean
    return out, (mean, weight, seen)


def smooth(x: np.ndarray, alpha: float, n: int) -> np.ndarray:
    return smooth_on(x, alpha, n)[0]


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, 2 / (n + 1), n)


def rma(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, 1 / n, n)


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([close[:1], close[:-1]])
    return np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    """Relative strength of smoothed gains and losses; without losses the ratio is 100."""
    d = np.diff(x, prepend=x[:1])
    gain, loss = rma(np.maximum(d, 0), n), rma(np.maximum(-d, 0), n)
    ratio = np.where(loss == 0, 100.0, gain / np.where(loss == 0, 1.0, loss))
    return 100 - 100 / (1 + ratio)


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(x, fast) - ema(x, slow)
    mean = ema(line, signal)
    return line, mean, line - mean


def cooldown(edges: np.ndarray, bars: int) -> np.ndarray:
    """Accept an edge when the last accepted one is `bars` or more behind."""
    out, last = np.zeros(len(edges), bool), -(10**18)
    for i in np.flatnonzero(edges).tolist():
        if i - last >= bars:
            out[i], last = True, i
    return out


def stop_and_reverse(high: np.ndarray, low: np.ndarray, close: np.ndarray, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    """A stop that closes in on the trend's extreme, faster with each new one, and changes sides when
    the price meets it; never beyond the two bars before. Missing at the first bar."""
    out = np.full(len(close), np.nan)
    if len(close) < 2:
        return out
    up = bool(close[1] > close[0])
    extreme, stop, pace = (high[1], low[0], start) if up else (low[1], high[0], start)
    for i in range(1, len(close)):
        stop += pace * (extreme - stop)
        met = stop > low[i] if up else stop < high[i]
        if met:
            stop = max(high[i], extreme) if up else min(low[i], extreme)
            up, extreme, pace = not up, (low[i] if up else high[i]), start
        elif i > 1 and (high[i] > extreme if up else low[i] < extreme):
            extreme, pace = (high[i] if up else low[i]), min(pace + step, most)
        past = slice(max(0, i - 2), i)
        stop = min(stop, low[past].min()) if up else max(stop, high[past].max())
        out[i] = stop
    return out


def lttb(x: np.ndarray, y: np.ndarray, points: int) -> np.ndarray:
    """Positions kept by largest-triangle-three-buckets downsampling; first and last stay."""
    n = len(x)
    if points >= n or points < 3:
        return np.arange(n)
    edges = (np.arange(points - 1) * ((n - 2) / (points - 2))).astype(int) + 1
    edges[-1] = n - 1
    kept, at = [0], 0
    for k in range(points - 2):
        a, b = edges[k], edges[k + 1]
        c = edges[k + 2] if k + 2 < len(edges) else n
        nx, ny = x[b : max(c, b + 1)].mean(), y[b : max(c, b + 1)].mean()
        area = np.abs((x[at] - nx) * (y[a:b] - y[at]) - (x[at] - x[a:b]) * (ny - y[at]))
        at = int(a + np.argmax(area))
        kept.append(at)
    return np.array([*kept, n - 1])


def smoothed(bars: DataFrame, **averages: tuple[str, str, float]) -> DataFrame:
    """bars with averages: new column = (source column, "ema" or "rma", length)."""
    kinds = {"ema": ema, "rma": rma}
    return fold(bars, lambda b: {name: kinds[kind](b[source], int(n)) for name, (source, kind, n) in averages.items()}, list(averages))


def fold(bars: DataFrame, compute: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: list[str], keys: list[str] | None = None, order: str = "timestamp") -> DataFrame:
    """bars with the columns that `compute` makes from the arrays of one series (missing: NaN in,
    NULL out). Names that start with is_ are boolean."""
    keys = keys or KEY
    schema = StructType([*bars.schema.fields, *[StructField(c, BooleanType() if c.startswith("is_") else DoubleType()) for c in columns]])
    names = bars.columns

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order).select(names)
        arrays = {f.name: group.column(f.name).to_numpy() for f in group.schema if pa.types.is_floating(f.type) or pa.types.is_integer(f.type)}
        made = compute(arrays)
        for c in columns:
            kind = pa.bool_() if c.startswith("is_") else pa.float64()
            group = group.append_column(c, pa.array(made[c], kind, from_pandas=True))
        return group

    return bars.groupBy(*keys).applyInArrow(run, schema)
