"""Ensembles: member signals in long form, votes per bar, and the pool they come from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import fold


def members(bars: DataFrame) -> DataFrame:
    """(symbol, interval, timestamp, bar_index, member, buy, sell) of window-only member rules."""
    b, rules = _window_rules(bars, length=14)
    return _long(b, rules)


def recursive_members(bars: DataFrame, length: int = 14) -> DataFrame:
    """The same of the rules that need averages with memory, all made in one fold."""
    b = fold.fold(bars, lambda x: recursive_lines(x, length), ["rsi", "fast", "slow", "macd", "macd_signal", "atr", "plus", "minus", "adx", "trend"])
    b = b.withColumns({"usual_atr": series.sma(F.col("atr"), 20), "was": F.lag("trend").over(series.by_series())})
    c = {name: F.col(name) for name in b.columns}
    return _long(b, {
        "rsi": (c["rsi"] < 30, c["rsi"] > 70),
        "macd": (series.crossover(c["macd"], c["macd_signal"]), series.crossunder(c["macd"], c["macd_signal"])),
        "ema_cross": (series.crossover(c["fast"], c["slow"]), series.crossunder(c["fast"], c["slow"])),
        "adx": ((c["adx"] > 25) & (c["plus"] > c["minus"]), (c["adx"] > 25) & (c["minus"] > c["plus"])),
        "atr": (c["atr"] < c["usual_atr"] * 0.8, c["atr"] > c["usual_atr"] * 1.2),
        "supertrend": ((c["trend"] > 0) & (c["was"] < 0), (c["trend"] < 0) & (c["was"] > 0)),
    })


def recursive_lines(b: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    h, low, c = b["high"], b["low"], b["close"]
    up, down = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
    ranged = fold.true_range(h, low, c)
    atr = fold.rma(ranged, n)
    with np.errstate(all="ignore"):
        plus, minus = (100 * fold.rma(np.where((x > y) & (x > 0), x, 0.0), n) / atr for x, y in ((up, down), (down, up)))
        adx = fold.rma(100 * np.abs(plus - minus) / (plus + minus), n)
    fast, slow = fold.ema(c, n), fold.ema(c, 2 * n)
    line = fast - slow
    return {
        "rsi": fold.rsi(c, n), "fast": fast, "slow": slow, "macd": line, "macd_signal": fold.ema(line, 9), "atr": atr, "plus": plus, "minus": minus, "adx": adx,
        "trend": trend(h, low, c, atr, 3.0),
    }


def trend(high: np.ndarray, low: np.ndarray, close: np.ndarray, atr: np.ndarray, factor: float) -> np.ndarray:
    """1 above and -1 below a trailing band `factor` true ranges from the bar's middle: the band only
    moves with the trend, and a close beyond it turns the trend. Missing while atr is."""
    out = np.full(len(close), np.nan)
    floor, roof, way, before = -np.inf, np.inf, 1.0, np.nan
    for i, (middle, width, c) in enumerate(zip(((high + low) / 2).tolist(), (factor * atr).tolist(), close.tolist())):
        if width == width:
            floor = max(floor, middle - width) if before >= floor else middle - width
            roof = min(roof, middle + width) if before <= roof else middle + width
            way = -1.0 if c < floor else 1.0 if c > roof else way
            out[i] = way
        before = c
    return out


def _long(b: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    for name, (buy, sell) in rules.items():
        b = b.withColumns({f"__{name}_b": F.coalesce(buy, F.lit(False)), f"__{name}_s": F.coalesce(sell, F.lit(False))})
    each = F.array(*[F.struct(F.lit(n).alias("member"), F.col(f"__{n}_b").alias("buy"), F.col(f"__{n}_s").alias("sell")) for n in rules])
    return b.select("symbol", "interval", "timestamp", "bar_index", F.inline(each))


def _window_rules(bars: DataFrame, length: int) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    zero = F.lit(0.0)
    b = series.with_mfi(series.with_cci(series.with_stoch(bars, 14, 3), 20), 14)
    b = b.withColumns({"__m": series.sma(c, 20), "__s": series.stdev(c, 20), "__r": series.roc(c, 14), "__short": series.sma(c, length), "__long": series.sma(c, 2 * length), "__prev": F.lag("close").over(series.by_series())})
    now, so_far, middle = series.by_series(), series.so_far(), (h + low) / 2
    before = F.lag("close").over(now)
    b = b.withColumns({
        "__mom": c - F.lag("close", length).over(now), "__obv": F.coalesce(F.sum(F.signum(c - F.col("__prev")) * v).over(so_far), zero),
        "__vwap": F.try_divide(F.sum((h + low + c) / 3 * v).over(so_far), F.sum(v).over(so_far)),
        "__tenkan": (series.highest(h, 9) + series.lowest(low, 9)) / 2, "__kijun": (series.highest(h, 26) + series.lowest(low, 26)) / 2,
        "__pivot": (F.lag("high").over(now) + F.lag("low").over(now) + before) / 3, "__ao": series.sma(middle, 5) - series.sma(middle, 34),
        "__flow": F.coalesce(F.try_divide((c - low) - (h - c), h - low), zero) * v,
    })
    b = b.withColumns({
        "__obv_mean": series.sma(F.col("__obv"), length), "__ac": F.col("__ao") - series.sma(F.col("__ao"), 5),
        "__cmf": F.try_divide(series.sma(F.col("__flow"), length), series.sma(v, length)), "__r_mean": series.sma(F.col("__r"), 5),
    })
    was = {x: F.lag(x).over(now) for x in ("__mom", "__ac")}
    hh, ll = series.highest(h, 14), series.lowest(low, 14)
    b = b.withColumn("__w", F.when(hh > ll, F.try_divide(-100 * (hh - c), hh - ll)))
    rules: dict[str, tuple[Column, Column]] = {
        "stoch": ((F.col("stoch_k") < 20) & series.crossover(F.col("stoch_k"), F.col("stoch_d")), (F.col("stoch_k") > 80) & series.crossunder(F.col("stoch_k"), F.col("stoch_d"))),
        "cci": (F.col("cci") < -100, F.col("cci") > 100),
        "mfi": (F.col("mfi") < 20, F.col("mfi") > 80),
        "bollinger": (c < F.col("__m") - 2 * F.col("__s"), c > F.col("__m") + 2 * F.col("__s")),
        "williams": (F.col("__w") < -80, F.col("__w") > -20),
        "sma_cross": (series.crossover(F.col("__short"), F.col("__long")), series.crossunder(F.col("__short"), F.col("__long"))),
        "momentum": ((F.col("__mom") > 0) & (F.col("__mom") > was["__mom"]), (F.col("__mom") < 0) & (F.col("__mom") < was["__mom"])),
        "obv": (F.col("__obv") > F.col("__obv_mean"), F.col("__obv") < F.col("__obv_mean")),
        "vwap": (series.crossover(c, F.col("__vwap")), series.crossunder(c, F.col("__vwap"))),
        "ichimoku": (series.crossover(F.col("__tenkan"), F.col("__kijun")), series.crossunder(F.col("__tenkan"), F.col("__kijun"))),
        "pivot": (series.crossover(c, F.col("__pivot")), series.crossunder(c, F.col("__pivot"))),
        "accelerator": ((F.col("__ac") > 0) & (F.col("__ac") > was["__ac"]), (F.col("__ac") < 0) & (F.col("__ac") < was["__ac"])),
        "chaikin": (F.col("__cmf") > 0.05, F.col("__cmf") < -0.05),
        "generic": ((F.col("__r") > 0) & series.crossover(F.col("__r"), F.col("__r_mean")), (F.col("__r") < 0) & series.crossunder(F.col("__r"), F.col("__r_mean"))),
    }
    return b, rules


def votes(signals: DataFrame, rule: str = "majority", threshold: float = 0.5) -> DataFrame:
    """Vote ratios, strength, and the decision of a unanimous, weighted or majority rule."""
    keys = ["symbol", "interval", "timestamp", "bar_index"]
    v = signals.groupBy(*keys).agg(F.avg(F.col("buy").cast("double")).alias("buy_ratio"), F.avg(F.col("sell").cast("double")).alias("sell_ratio"))

    def decide(ratio: str) -> Column:
        x = F.col(ratio)
        return {"unanimous": x >= 1, "weighted": x >= threshold, "majority": x > 0.5}[rule]

    return v.withColumns({"buy_signal": decide("buy_ratio"), "sell_signal": decide("sell_ratio"), "strength": F.col("buy_ratio") - F.col("sell_ratio")})


def pool(results: DataFrame, n: int, min_score: float) -> DataFrame:
    """The n best results of each (symbol, interval) that reach a score, where two or more do."""
    from pyspark.sql.window import Window

    score = F.coalesce(F.col("objective_best"), F.col("mcc") + 0.5 * (F.col("roc_auc") - 0.5))
    w = Window.partitionBy("symbol", "interval")
    ranked = results.withColumn("score", score).where(F.col("score") >= min_score)
    ranked = ranked.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "name")), "members": F.count("*").over(w)})
    return ranked.where((F.col("rank") <= n) & (F.col("members") >= 2))
