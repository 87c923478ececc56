"""Queries of the series and scalar functions over 4-hour event bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalar, series
from tickloom.plans import sql
from tickloom.plans.registry import register
from tickloom.plans.sql import CUM, LAG, rows
from tickloom.sources.bars import event_bars, indexed

D = 6


def bars(spark, sf_dir: str) -> DataFrame:
    return indexed(event_bars(spark, sf_dir))


def rounded(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    kinds = dict(df.select(*[c.alias(n) for n, c in columns.items()]).dtypes)
    return df.select("symbol", "bar_index", *[(F.round(c, D) if kinds[n] == "double" else c).alias(n) for n, c in columns.items()])


def simple(name: str, select: str, ctes: str = "", source: str = "b", where: str = "", prepare=None, *, columns: Callable[[DataFrame], dict[str, Column]]) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        df = bars(spark, sf_dir)
        df = prepare(df) if prepare else df
        return rounded(df, columns(df))

    register(name, run, sql.over_bars(select, ctes, source, where))


def r(x: str, name: str) -> str:
    return f"round({x}, {D}) AS {name}"


simple(
    "w01_sma", r(sql.sma("close", 14), "sma"),
    columns=lambda b: dict(sma=series.sma(b.close, 14)),
)
simple(
    "w02_wma", r("(" + " + ".join(f"{10 - k} * lag(close, {k}) OVER {LAG}" for k in range(10)) + ") / 55.0", "wma"),
    columns=lambda b: dict(wma=series.wma(b.close, 10)),
)
simple(
    "w03_vwma", r(f"CASE WHEN count(close) OVER {rows(14)} = 14 THEN sum(close * volume) OVER {rows(14)} / sum(volume) OVER {rows(14)} END", "vwma"),
    columns=lambda b: dict(vwma=series.vwma(b.close, b.volume, 14)),
)
TR = f"greatest(high - low, abs(high - coalesce(lag(close) OVER {LAG}, close)), abs(low - coalesce(lag(close) OVER {LAG}, close)))"
simple(
    "w04_true_range", r(TR, "tr"),
    columns=lambda b: dict(tr=series.true_range(b.high, b.low, b.close)),
)
simple(
    "w05_stdev", r(sql.stdev("close", 14), "stdev"),
    columns=lambda b: dict(stdev=series.stdev(b.close, 14)),
)
simple(
    "w06_variance", f"round(CASE WHEN count(close) OVER {rows(14)} = 14 THEN var_pop(close) OVER {rows(14)} END, 4) AS variance",
    columns=lambda b: dict(variance=F.round(series.variance(b.close, 14), 4)),
)
TP = f't AS (SELECT *, (high + low + close) / 3 AS tp FROM b), u AS (SELECT *, list(tp) OVER {rows(20)} AS l, {sql.sma("tp", 20)} AS m FROM t)'
simple(
    "w07_cci", r("CASE WHEN m IS NULL THEN NULL WHEN list_avg(list_transform(l, lambda x: abs(x - m))) = 0 THEN 0 ELSE (tp - m) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - m)))) END", "cci"), TP, "u",
    columns=lambda b: dict(cci=F.col("cci")),
    prepare=lambda d: series.with_cci(d, 20),
)
FLOW = f"""t AS (SELECT *, (high + low + close) / 3 AS tp FROM b), u AS (SELECT *, tp - coalesce(lag(tp) OVER {LAG}, tp) AS d, tp * volume AS f FROM t),
v AS (SELECT *, sum(CASE WHEN d > 0 THEN f ELSE 0 END) OVER {rows(14)} AS pos, sum(CASE WHEN d < 0 THEN f ELSE 0 END) OVER {rows(14)} AS neg, count(f) OVER {rows(14)} AS n FROM u)"""
simple(
    "w08_mfi", r("CASE WHEN n = 14 THEN 100 - 100 / (1 + CASE WHEN neg = 0 THEN 100 ELSE pos / neg END) END", "mfi"), FLOW, "v",
    columns=lambda b: dict(mfi=F.col("mfi")),
    prepare=lambda d: series.with_mfi(d, 14),
)
STOCH = f"""t AS (SELECT *, max(high) OVER {rows(14)} AS hh, min(low) OVER {rows(14)} AS ll FROM b),
u AS (SELECT *, CASE WHEN hh = ll THEN 50 ELSE 100 * (close - ll) / (hh - ll) END AS k FROM t)"""
simple(
    "w09_stoch", r("k", "stoch_k") + ", " + r(sql.sma("k", 3), "stoch_d"), STOCH, "u",
    columns=lambda b: dict(stoch_k=F.col("stoch_k"), stoch_d=F.col("stoch_d")),
    prepare=lambda d: series.with_stoch(d, 14, 3),
)
simple(
    "w10_highest", r(f"max(high) OVER {rows(14)}", "highest"),
    columns=lambda b: dict(highest=series.highest(b.high, 14)),
)
simple(
    "w11_lowest", r(f"min(low) OVER {rows(14)}", "lowest"),
    columns=lambda b: dict(lowest=series.lowest(b.low, 14)),
)
simple(
    "w12_highest_bars", f"arg_max(bar_index, (round(close, 0), -bar_index)) OVER {rows(10)} - bar_index AS back",
    columns=lambda b: dict(back=series.highest_bars(F.round(b.close, 0), 10)),
)
simple(
    "w13_lowest_bars", f"arg_min(bar_index, (round(close, 0), bar_index)) OVER {rows(10)} - bar_index AS back",
    columns=lambda b: dict(back=series.lowest_bars(F.round(b.close, 0), 10)),
)
PIVOT = "CASE WHEN bar_index >= 7 AND {f}(close) OVER (" + sql.O + " ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) {lt} lag(close, 3) OVER " + LAG + " AND {f}(close) OVER (" + sql.O + " ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) {lt}= lag(close, 3) OVER " + LAG + " THEN lag(close, 3) OVER " + LAG + " END"
simple(
    "w14_pivot_high", r(PIVOT.format(f="max", lt="<"), "pivot"),
    columns=lambda b: dict(pivot=series.pivot_high(b.close, 4, 3)),
)
simple(
    "w15_pivot_low", r(PIVOT.format(f="min", lt=">"), "pivot"),
    columns=lambda b: dict(pivot=series.pivot_low(b.close, 4, 3)),
)
AVERAGE = f"t AS (SELECT *, {sql.sma('close', 14)} AS a FROM b)"


def with_average(df: DataFrame) -> DataFrame:
    return df.withColumn("a", series.sma(df.close, 14))


OVER = f"coalesce(lag(close) OVER {LAG} <= lag(a) OVER {LAG} AND close > a, false)"
UNDER = f"coalesce(lag(close) OVER {LAG} >= lag(a) OVER {LAG} AND close < a, false)"
simple(
    "w16_cross", f"{OVER} OR {UNDER} AS crossed", AVERAGE, "t",
    columns=lambda b: dict(crossed=series.cross(b.close, b.a)),
    prepare=with_average,
)
simple(
    "w17_crossover", f"{OVER} AS crossed", AVERAGE, "t",
    columns=lambda b: dict(crossed=series.crossover(b.close, b.a)),
    prepare=with_average,
)
simple(
    "w18_crossunder", f"{UNDER} AS crossed", AVERAGE, "t",
    columns=lambda b: dict(crossed=series.crossunder(b.close, b.a)),
    prepare=with_average,
)
CHANGE = "CASE WHEN bar_index < {n} THEN 0 ELSE close - lag(close, {n}) OVER " + LAG + " END"
simple(
    "w19_change", r(CHANGE.format(n=1), "change"),
    columns=lambda b: dict(change=series.change(b.close)),
)
simple(
    "w20_roc", r(f"CASE WHEN lag(close, 5) OVER {LAG} = 0 THEN 0 ELSE 100 * (close - lag(close, 5) OVER {LAG}) / lag(close, 5) OVER {LAG} END", "roc"),
    columns=lambda b: dict(roc=series.roc(b.close, 5)),
)
simple(
    "w21_momentum", r(CHANGE.format(n=10), "momentum"),
    columns=lambda b: dict(momentum=series.change(b.close, 10)),
)
simple(
    "w22_bars_since", f"bar_index - last_value(CASE WHEN close > open THEN bar_index END IGNORE NULLS) OVER {CUM} AS since",
    columns=lambda b: dict(since=series.bars_since(b.close > b["open"])),
)
VALUE = f"list(close) FILTER (close > open) OVER {CUM}"
simple(
    "w23_value_when", r(f"list_extract({VALUE}, -1)", "latest") + ", " + r(f"list_extract({VALUE}, -3)", "third"),
    columns=lambda b: dict(latest=series.value_when(b.close > b["open"], b.close), third=F.col("third")),
    prepare=lambda d: series.with_value_when(d, d.close > d["open"], d.close, 2, "third"),
)
simple(
    "w24_cum", r(f"coalesce(sum(volume) OVER {CUM}, 0)", "total"),
    columns=lambda b: dict(total=series.cum(b.volume)),
)
simple(
    "w25_rolling_sum", r(f"sum(volume) OVER {rows(14)}", "total"),
    columns=lambda b: dict(total=series.rolling_sum(b.volume, 14)),
)
CENTRED = "t AS (SELECT *, close - open AS x FROM b)"


def with_move(df: DataFrame) -> DataFrame:
    return df.withColumn("x", df.close - df["open"])


simple(
    "w26_normalise_so_far", r(f"greatest(least(x / CASE WHEN max(abs(x)) OVER {CUM} = 0 THEN 1 ELSE max(abs(x)) OVER {CUM} END, 1), -1)", "signal"), CENTRED, "t",
    columns=lambda b: dict(signal=series.normalise_so_far(b.x)),
    prepare=with_move,
)
simple(
    "w27_zscore", f"round(coalesce(CASE WHEN {sql.stdev('close', 14)} > 0 THEN (close - {sql.sma('close', 14)}) / ({sql.stdev('close', 14)}) END, 0), 5) AS z",
    columns=lambda b: dict(z=F.round(series.zscore(b.close, 14), 5)),
)
simple(
    "w28_rolling_flow", r(f"sum(x) OVER {rows(50)}", "flow"), "t AS (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS x FROM b)", "t",
    columns=lambda b: dict(flow=series.rolling_sum(F.when(b.high == b.low, 0.0).otherwise(F.try_divide((b.close - b.low) - (b.high - b.close), b.high - b.low) * b.volume), 50)),
)
simple(
    "w29_normalise_rolling", r(f"CASE WHEN max(abs(x)) OVER {rows(14)} > 0 THEN greatest(least(x / (max(abs(x)) OVER {rows(14)} + 1e-10), 1), -1) ELSE 0 END", "signal"), CENTRED, "t",
    columns=lambda b: dict(signal=series.normalise_rolling(b.x, 14)),
    prepare=with_move,
)
simple(
    "w30_local_extremes", f"close = min(close) OVER {rows(5)} AS is_low, close = max(close) OVER {rows(5)} AS is_high",
    columns=lambda b: dict(is_low=b.close == series.lowest(b.close, 5), is_high=b.close == series.highest(b.close, 5)),
)
simple(
    "w31_edge", f"(close > open) AND NOT coalesce(lag(close > open) OVER {LAG}, false) AS edge",
    columns=lambda b: dict(edge=series.edge(b.close > b["open"])),
)
EFFICIENCY = f"t AS (SELECT *, abs({CHANGE.format(n=1)}) AS d, abs({CHANGE.format(n=10)}) AS net FROM b)"
simple(
    "w32_efficiency", r(f"coalesce(net / ({sql.sma('d', 10)} * 10 + 1e-10), 0)", "efficiency"), EFFICIENCY, "t",
    columns=lambda b: dict(efficiency=F.col("efficiency")),
    prepare=lambda d: series.with_efficiency(d, 10),
)
RETURNS = f"t AS (SELECT *, 100 * (close - lag(close) OVER {LAG}) / nullif(lag(close) OVER {LAG}, 0) AS x FROM b)"
simple(
    "w33_trailing_volatility", f"round(CASE WHEN bar_index >= 20 THEN stddev_pop(x) OVER ({sql.O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * sqrt(8760 / 4.0) END, 3) AS volatility", RETURNS, "t",
    columns=lambda b: dict(volatility=F.round(series.trailing_volatility(b.x, 20, 4.0), 3)),
    prepare=lambda d: d.withColumn("x", series.roc(d.close, 1)),
)
IMPROVE = f"t AS (SELECT *, max(close) OVER ({sql.O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM b)"
simple(
    "w34_improving", r("close", "best"), IMPROVE, "t", "WHERE best IS NULL OR close > best",
    columns=lambda b: dict(best=b.close),
    prepare=lambda d: d.withColumn("so_far", F.max("close").over(series.before())).where("so_far IS NULL OR close > so_far"),
)
EQUITY = f"t AS (SELECT *, coalesce((close - open) / nullif(open, 0) / 100, 0) AS x FROM b), u AS (SELECT *, 100 * exp(sum(ln(1 + x)) OVER {CUM}) AS equity FROM t)"


def with_equity(df: DataFrame) -> DataFrame:
    x = F.coalesce(F.try_divide(df.close - df["open"], df["open"]) / 100, F.lit(0.0))
    return df.withColumn("equity", 100 * F.exp(F.sum(F.ln(1 + x)).over(series.so_far())))


simple(
    "w35_drawdown", r("equity", "equity") + ", " + r(f"(equity - max(equity) OVER {CUM}) / max(equity) OVER {CUM} * 100", "drawdown"), EQUITY, "u",
    columns=lambda b: dict(equity=b.equity, drawdown=(b.equity - F.max(b.equity).over(series.so_far())) / F.max(b.equity).over(series.so_far()) * 100),
    prepare=with_equity,
)
STEPS = IMPROVE + f', u AS (SELECT *, close - best AS gain FROM t WHERE best IS NULL OR close > best), v AS (SELECT *, avg(gain) OVER {rows(5)} AS mean5, max(gain) OVER {CUM} AS peak FROM u)'


def with_steps(df: DataFrame) -> DataFrame:
    up = df.withColumn("so_far", F.max("close").over(series.before())).where("so_far IS NULL OR close > so_far")
    return up.withColumn("gain", up.close - up.so_far)


simple(
    "w36_improvement_rates", r("gain", "gain") + ", " + r("mean5", "mean5") + ", " + r("peak", "peak"), STEPS, "v",
    columns=lambda b: dict(gain=b.gain, mean5=F.avg(b.gain).over(series.last_rows(5)), peak=F.max(b.gain).over(series.so_far())),
    prepare=with_steps,
)
RATE = IMPROVE + f', u AS (SELECT *, bar_index - lag(bar_index) OVER {LAG} AS bars, first_value(close) OVER {CUM} AS base, lag(close) OVER {LAG} AS prior FROM t WHERE best IS NULL OR close > best)'
simple(
    "w37_marginal_rate", r("(close - base) / nullif(abs(base), 0) * 100 / nullif(bar_index, 0)", "rate") + ", " + r("(close - prior) / nullif(abs(prior), 0) * 100 / bars", "marginal"), RATE, "u",
    columns=lambda b: dict(rate=F.try_divide(F.try_divide(b.close - F.first("close").over(series.so_far()), F.abs(F.first("close").over(series.so_far()))) * 100, F.col("bar_index")), marginal=F.try_divide(F.try_divide(b.close - F.lag("close").over(series.by_series()), F.abs(F.lag("close").over(series.by_series()))) * 100, F.col("bar_index") - F.lag("bar_index").over(series.by_series()))),
    prepare=with_steps,
)

MOVE = with_move
simple(
    "m01_m08_math", ", ".join([r("abs(x)", "magnitude"), r("greatest(open, close)", "larger"), r("least(open, close)", "smaller"), r("CASE WHEN x > 0 THEN ln(x) END", "log"), r("exp(x / 1000)", "exponential"), r("CASE WHEN x >= 0 THEN sqrt(x) END", "root"), r("power(x, 2)", "square"), r("sign(x)", "direction")]), CENTRED, "t",
    columns=lambda b: dict(magnitude=F.abs(b.x), larger=scalar.maximum(b["open"], b.close), smaller=scalar.minimum(b["open"], b.close), log=scalar.log(b.x), exponential=F.exp(b.x / 1000), root=scalar.sqrt(b.x), square=F.pow(b.x, F.lit(2.0)), direction=F.signum(b.x)),
    prepare=MOVE,
)
simple(
    "m09_m11_rounding", "round_even(x, 0) AS even, CAST(floor(x) AS DOUBLE) AS down, CAST(ceil(x) AS DOUBLE) AS up", CENTRED, "t",
    columns=lambda b: dict(even=F.bround(b.x, 0), down=F.floor(b.x).cast("double"), up=F.ceil(b.x).cast("double")),
    prepare=MOVE,
)
simple(
    "m12_m14_missing", ", ".join(["coalesce(lag(close, 3) OVER " + LAG + ", 0) AS filled", "lag(close, 3) OVER " + LAG + " IS NULL AS missing", r("coalesce(close / nullif(x, 0), -1)", "ratio")]), CENTRED, "t",
    columns=lambda b: dict(filled=F.coalesce(F.lag(b.close, 3).over(series.by_series()), F.lit(0.0)), missing=F.lag(b.close, 3).over(series.by_series()).isNull(), ratio=scalar.safe_divide(b.close, b.x, -1.0)),
    prepare=MOVE,
)
simple(
    "m15_m17_prices", ", ".join([r("tanh(greatest(least(x, 20), -20))", "soft"), r("greatest(least(x, 5), -5)", "clipped"), r("(high + low) / 2", "hl2"), r("(high + low + close) / 3", "hlc3"), r("(open + high + low + close) / 4", "ohlc4")]), CENTRED, "t",
    columns=lambda b: dict(soft=scalar.soft_tanh(b.x), clipped=series.clip(b.x, -5.0, 5.0), hl2=(b.high + b.low) / 2, hlc3=(b.high + b.low + b.close) / 3, ohlc4=(b["open"] + b.high + b.low + b.close) / 4),
    prepare=MOVE,
)
