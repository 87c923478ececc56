"""Series functions over bars: Columns windowed by series, rows counted, never times.

A series is a (symbol, interval) in timestamp order. Missing values are NULL. Averages need a full
frame of values; extremes and sums accept a partial one.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_series() -> WindowSpec:
    return Window.partitionBy("symbol", "interval").orderBy("timestamp")


def so_far() -> WindowSpec:
    return by_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return by_series().rowsBetween(Window.unboundedPreceding, -1)


def last_rows(n: int) -> WindowSpec:
    return by_series().rowsBetween(1 - n, 0)


def _full(x: Column, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(last_rows(n)) == n, value)


def sma(x: Column, n: int) -> Column:
    return _full(x, n, F.avg(x).over(last_rows(n)))


def wma(x: Column, n: int) -> Column:
    """Weights 1 to n, the newest weighs n."""
    total = reduce(add, [(F.lag(x, k).over(by_series()) if k else x) * (n - k) for k in range(n)])
    return total / F.lit(n * (n + 1) / 2)


def vwma(x: Column, volume: Column, n: int) -> Column:
    w = last_rows(n)
    return F.when((F.count(x * volume).over(w) == n) & (F.count(volume).over(w) == n), F.try_divide(F.sum(x * volume).over(w), F.sum(volume).over(w)))


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = F.coalesce(F.lag(close).over(by_series()), close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def stdev(x: Column, n: int) -> Column:
    return _full(x, n, F.stddev_pop(x).over(last_rows(n)))


def variance(x: Column, n: int) -> Column:
    return _full(x, n, F.var_pop(x).over(last_rows(n)))


def highest(x: Column, n: int) -> Column:
    return F.max(x).over(last_rows(n))


def lowest(x: Column, n: int) -> Column:
    return F.min(x).over(last_rows(n))


def highest_bars(x: Column, n: int) -> Column:
    """Minus the bars back to the frame's maximum; ties: the oldest."""
    i = F.col("bar_index")
    return F.max_by(i, F.when(x.isNotNull(), F.struct(x, -i))).over(last_rows(n)) - i


def lowest_bars(x: Column, n: int) -> Column:
    i = F.col("bar_index")
    return F.min_by(i, F.when(x.isNotNull(), F.struct(x, i))).over(last_rows(n)) - i


def pivot_high(x: Column, left: int, right: int) -> Column:
    """The value `right` bars ago where it exceeds the `left` before and is not exceeded since."""
    c = F.lag(x, right).over(by_series())
    ok = (F.col("bar_index") >= left + right) & (F.max(x).over(by_series().rowsBetween(-(right + left), -(right + 1))) < c)
    if right:
        ok &= F.max(x).over(by_series().rowsBetween(1 - right, 0)) <= c
    return F.when(ok, c)


def pivot_low(x: Column, left: int, right: int) -> Column:
    return -pivot_high(-x, left, right)


def crossover(a: Column, b: Column) -> Column:
    return F.coalesce((F.lag(a).over(by_series()) <= F.lag(b).over(by_series())) & (a > b), F.lit(False))


def crossunder(a: Column, b: Column) -> Column:
    return F.coalesce((F.lag(a).over(by_series()) >= F.lag(b).over(by_series())) & (a < b), F.lit(False))


def cross(a: Column, b: Column) -> Column:
    return crossover(a, b) | crossunder(a, b)


def change(x: Column, n: int = 1) -> Column:
    """x minus x n bars ago; 0 in the first n bars."""
    return F.when(F.col("bar_index") < n, F.lit(0.0)).otherwise(x - F.lag(x, n).over(by_series()))


def roc(x: Column, n: int) -> Column:
    before = F.lag(x, n).over(by_series())
    return F.when(before == 0, F.lit(0.0)).otherwise(F.try_divide(100 * (x - before), before))


def bars_since(condition: Column) -> Column:
    i = F.col("bar_index")
    return i - F.last(F.when(condition, i), ignorenulls=True).over(so_far())


def value_when(condition: Column, x: Column) -> Column:
    """x at the latest bar where the condition held."""
    return F.last(F.when(condition, F.struct(x.alias("v"))), ignorenulls=True).over(so_far())["v"]


def cum(x: Column) -> Column:
    return F.coalesce(F.sum(x).over(so_far()), F.lit(0.0))


def rolling_sum(x: Column, n: int) -> Column:
    return F.sum(x).over(last_rows(n))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def normalise_so_far(x: Column) -> Column:
    """x over the greatest absolute value so far, within -1 and 1; over 1 while that is 0."""
    top = F.max(F.abs(x)).over(so_far())
    return clip(x / F.when(top == 0, F.lit(1.0)).otherwise(top), -1.0, 1.0)


def normalise_rolling(x: Column, n: int) -> Column:
    top = F.max(F.abs(x)).over(last_rows(n))
    return F.when(top > 0, clip(x / (top + 1e-10), -1.0, 1.0)).otherwise(F.lit(0.0))


def zscore(x: Column, n: int) -> Column:
    """Deviation from the mean in standard deviations; 0 where there is none."""
    return F.coalesce(F.try_divide(x - sma(x, n), stdev(x, n)), F.lit(0.0))


def edge(condition: Column) -> Column:
    c = F.coalesce(condition, F.lit(False))
    return c & ~F.coalesce(F.lag(c).over(by_series()), F.lit(False))


def trailing_volatility(r: Column, n: int, interval_hours: float) -> Column:
    """Annualised deviation of the n returns before this bar."""
    return F.when(F.col("bar_index") >= n, F.stddev_pop(r).over(by_series().rowsBetween(-n, -1)) * F.lit((8760 / interval_hours) ** 0.5))


def forward_return(close: Column, h: int) -> Column:
    return F.try_divide(F.lead(close, h).over(by_series()) - close, close) * 100


# Functions that need a windowed column before they can be windowed themselves.


def with_value_when(bars: DataFrame, condition: Column, x: Column, k: int, out: str) -> DataFrame:
    """x at the k-th most recent bar where the condition held (0: the latest): a lag among these
    bars alone, carried on to the others. No list of them is kept."""
    b = bars.withColumns({"__held": F.coalesce(condition, F.lit(False)), "__x": F.struct(x.alias("v"))})
    among = Window.partitionBy("symbol", "interval", "__held").orderBy("timestamp")
    b = b.withColumn("__kth", F.when(F.col("__held"), F.lag("__x", k).over(among)))
    return b.withColumn(out, F.last("__kth", ignorenulls=True).over(so_far())["v"]).drop("__held", "__x", "__kth")


def with_efficiency(bars: DataFrame, n: int, out: str = "efficiency") -> DataFrame:
    """Net change over the path walked; 0 where that is not known."""
    x = F.col("close")
    b = bars.withColumn("__d", F.abs(change(x, 1))).withColumn("__net", F.abs(change(x, n)))
    return b.withColumn(out, F.coalesce(F.col("__net") / (sma(F.col("__d"), n) * n + 1e-10), F.lit(0.0))).drop("__d", "__net")


def with_cci(bars: DataFrame, n: int, out: str = "cci") -> DataFrame:
    b = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("__l", F.collect_list("__tp").over(last_rows(n))).withColumn("__m", sma(F.col("__tp"), n))
    b = b.withColumn("__d", F.aggregate("__l", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("__m"))) / F.size("__l"))
    value = F.when(F.col("__d") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("__tp") - F.col("__m"), 0.015 * F.col("__d")))
    return b.withColumn(out, F.when(F.col("__m").isNotNull(), value)).drop("__tp", "__l", "__m", "__d")


def with_mfi(bars: DataFrame, n: int, out: str = "mfi") -> DataFrame:
    """Money-flow index; without losing flow the ratio is 100."""
    b = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = b.withColumn("__d", change(F.col("__tp"))).withColumn("__f", F.col("__tp") * F.col("volume"))
    up, down = F.when(F.col("__d") > 0, F.col("__f")).otherwise(0.0), F.when(F.col("__d") < 0, F.col("__f")).otherwise(0.0)
    w = last_rows(n)
    ratio = F.when(F.sum(down).over(w) == 0, F.lit(100.0)).otherwise(F.try_divide(F.sum(up).over(w), F.sum(down).over(w)))
    return b.withColumn(out, F.when(F.count("__f").over(w) == n, 100 - 100 / (1 + ratio))).drop("__tp", "__d", "__f")


def with_stoch(bars: DataFrame, k: int, d: int, out: str = "stoch") -> DataFrame:
    high, low = highest(F.col("high"), k), lowest(F.col("low"), k)
    b = bars.withColumn(f"{out}_k", F.when(high == low, F.lit(50.0)).otherwise(F.try_divide(100 * (F.col("close") - low), high - low)))
    return b.withColumn(f"{out}_d", sma(F.col(f"{out}_k"), d))


# Order statistics and regressions over moving frames.


def percentrank(x: Column, n: int) -> Column:
    """Share, in percent, of the n values before that are not over x; missing until they are there."""
    past = F.collect_list(x).over(by_series().rowsBetween(-n, -1))
    return F.when(x.isNotNull() & (F.size(past) == n), 100.0 * F.size(F.filter(past, lambda v: v <= x)) / n)


def correlation(x: Column, y: Column, n: int) -> Column:
    """Pearson correlation of n rows; missing without a full frame, and where a side does not vary."""
    w = last_rows(n)
    spread = F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)
    return F.when((F.count(x).over(w) == n) & (F.count(y).over(w) == n), F.try_divide(F.covar_pop(x, y).over(w), spread))


def linreg(x: Column, n: int, offset: int = 0) -> Column:
    """The least-squares line through n rows at its end, `offset` rows back; from sums, the row's place
    counted from the newest, so that they stay small."""
    w, i = last_rows(n), F.col("bar_index")
    total, weighted = F.sum(x).over(w), F.sum(x * i).over(w) - i * F.sum(x).over(w)
    middle, spread = -(n - 1) / 2, n * (n * n - 1) / 12
    slope = (weighted - middle * total) / spread if n > 1 else F.lit(0.0)
    return _full(x, n, total / n + slope * (-offset - middle))


def aroon(high: Column, low: Column, n: int) -> tuple[Column, Column]:
    """(up, down): how recent the extremes of n bars and this one are, 100 for this bar; of equal
    extremes the newest. Missing until the frame is full."""
    w, i = last_rows(n + 1), F.col("bar_index")
    top = F.max_by(i, F.when(high.isNotNull(), F.struct(high, i))).over(w)
    bottom = F.max_by(i, F.when(low.isNotNull(), F.struct(-low, i))).over(w)
    return tuple(F.when(i >= n, 100.0 * (n - (i - at)) / n) for at in (top, bottom))
