"""Queries of recursive series, evaluators, walk-forward evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import backtest, fold, indicators, stats
from tickloom.plans import sql
from tickloom.plans.registry import register
from tickloom.plans.series_queries import CHANGE, FLOW, TP, bars, r
from tickloom.plans.sql import BARS, CUM, LAG, O, rows

KEY = ["symbol", "bar_index"]


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def recursive(name: str, state: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {BARS}{', ' + ctes if ctes else ''}, {name} AS ({state})"


def smooth_sql(name: str, source: str, x: str, alpha: str, first: int = 0) -> str:
    return (
        f"{name} AS (SELECT symbol, bar_index, {x} AS y FROM {source} WHERE bar_index = {first} UNION ALL "
        f"SELECT s.symbol, s.bar_index, (1 - {alpha}) * e.y + {alpha} * s.{x} FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.bar_index = e.bar_index + 1)"
    )


def folded(spark, sf_dir, compute, *columns: str) -> DataFrame:
    return shown(fold.fold(bars(spark, sf_dir), compute, list(columns)), *KEY, *columns)


register("f01_ema", lambda s, d: folded(s, d, lambda b: {"ema": fold.ema(b["close"], 12)}, "ema"),
         f"WITH RECURSIVE {BARS}, {smooth_sql('e', 'b', 'close', '(2.0::DOUBLE / 13)')} SELECT symbol, bar_index, round(CASE WHEN bar_index >= 11 THEN y END, 6) AS ema FROM e")
register("f02_rma", lambda s, d: folded(s, d, lambda b: {"rma": fold.rma(b["close"], 14)}, "rma"),
         f"WITH RECURSIVE {BARS}, {smooth_sql('e', 'b', 'close', '(1.0::DOUBLE / 14)')} SELECT symbol, bar_index, round(CASE WHEN bar_index >= 13 THEN y END, 6) AS rma FROM e")
TRUE = f"t AS (SELECT *, greatest(high - low, abs(high - coalesce(lag(close) OVER {LAG}, close)), abs(low - coalesce(lag(close) OVER {LAG}, close))) AS tr FROM b)"
register("f03_atr", lambda s, d: folded(s, d, lambda b: {"atr": fold.rma(fold.true_range(b["high"], b["low"], b["close"]), 14)}, "atr"),
         f"WITH RECURSIVE {BARS}, {TRUE}, {smooth_sql('e', 't', 'tr', '(1.0::DOUBLE / 14)')} SELECT symbol, bar_index, round(CASE WHEN bar_index >= 13 THEN y END, 6) AS atr FROM e")
MOVES = f"t AS (SELECT *, greatest({CHANGE.format(n=1)}, 0) AS up, greatest(-({CHANGE.format(n=1)}), 0) AS down FROM b)"
RSI = f"{MOVES}, {smooth_sql('g', 't', 'up', '(1.0::DOUBLE / 14)')}, {smooth_sql('l', 't', 'down', '(1.0::DOUBLE / 14)')}, rsi AS (SELECT b.symbol, b.\"interval\", b.\"timestamp\", bar_index, CASE WHEN bar_index >= 13 THEN 100 - 100 / (1 + CASE WHEN l.y = 0 THEN 100 ELSE g.y / l.y END) END AS rsi FROM b JOIN g USING (symbol, bar_index) JOIN l USING (symbol, bar_index))"
register("f04_rsi", lambda s, d: folded(s, d, lambda b: {"rsi": fold.rsi(b["close"], 14)}, "rsi"), f"WITH RECURSIVE {BARS}, {RSI} SELECT symbol, bar_index, round(rsi, 6) AS rsi FROM rsi")
MACD = f"{smooth_sql('f', 'b', 'close', '(2.0::DOUBLE / 13)')}, {smooth_sql('s', 'b', 'close', '(2.0::DOUBLE / 27)')}, line AS (SELECT symbol, bar_index, f.y - s.y AS line FROM f JOIN s USING (symbol, bar_index) WHERE bar_index >= 25), {smooth_sql('g', 'line', 'line', '(2.0::DOUBLE / 10)', 25)}"
MACD += ', macd AS (SELECT b.symbol, b."interval", b."timestamp", bar_index, line.line, CASE WHEN bar_index >= 33 THEN g.y END AS signal FROM b LEFT JOIN line USING (symbol, bar_index) LEFT JOIN g USING (symbol, bar_index))'
register("f05_macd", lambda s, d: folded(s, d, lambda b: dict(zip(("line", "signal", "histogram"), fold.macd(b["close"], 12, 26, 9))), "line", "signal", "histogram"),
         f"WITH RECURSIVE {BARS}, {MACD} SELECT symbol, bar_index, round(line, 6) AS line, round(signal, 6) AS signal, round(line - signal, 6) AS histogram FROM macd")
COOL = f"""t AS (SELECT *, (close > open) AND NOT coalesce(lag(close > open) OVER {LAG}, false) AS edge FROM b),
c AS (SELECT symbol, bar_index, edge AS ok, CASE WHEN edge THEN 0 ELSE -1000000 END AS last FROM t WHERE bar_index = 0 UNION ALL
SELECT t.symbol, t.bar_index, t.edge AND t.bar_index - c.last >= 7, CASE WHEN t.edge AND t.bar_index - c.last >= 7 THEN t.bar_index ELSE c.last END FROM c JOIN t ON t.symbol = c.symbol AND t.bar_index = c.bar_index + 1)"""


def cooled(b):
    up = b["close"] > b["open"]
    up[1:] &= ~(b["close"] > b["open"])[:-1]
    return {"is_kept": fold.cooldown(up, 7)}


register("f06_cooldown", lambda s, d: folded(s, d, cooled, "is_kept"), f"WITH RECURSIVE {BARS}, {COOL} SELECT symbol, bar_index, ok AS is_kept FROM c")

SIGNALS = ("main_value", "buy_signal", "sell_signal", "combined_signal")


def signal_sql(ctes: str, value: str, source: str, buy: float = 0, sell: float = 0, recursive_: bool = False) -> str:
    top = f"max(abs(m)) OVER {CUM}"
    return f"""WITH {'RECURSIVE ' if recursive_ else ''}{BARS}, {ctes}, m AS (SELECT symbol, "interval", "timestamp", bar_index, {value} AS m FROM {source})
SELECT symbol, bar_index, round(m, 5) AS main_value, coalesce(lag(m) OVER {LAG} <= {buy} AND m > {buy}, false) AS buy_signal,
coalesce(lag(m) OVER {LAG} >= {sell} AND m < {sell}, false) AS sell_signal,
round(CASE WHEN m IS NULL THEN 0 ELSE greatest(least(m / CASE WHEN {top} = 0 THEN 1 ELSE {top} END, 1), -1) END, 5) AS combined_signal FROM m"""


def signals(df: DataFrame) -> DataFrame:
    return shown(df, *KEY, *SIGNALS, digits=5)


def z(n: int) -> str:
    return f"greatest(least(10 * coalesce(CASE WHEN {sql.stdev(f's{n}', n)} > 0 THEN (s{n} - {sql.sma(f's{n}', n)}) / ({sql.stdev(f's{n}', n)}) END, 0), 100), -100)"


SUMS = ", ".join(f"sum(f) OVER {rows(n)} AS s{n}" for n in indicators.FLOW_RANGES)
MFV = f"t AS (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END AS f FROM b), u AS (SELECT *, {SUMS} FROM t)"
register("i01_money_flow", lambda s, d: signals(indicators.money_flow(bars(s, d))), signal_sql(MFV, " + ".join(z(n) for n in indicators.FLOW_RANGES), "u"))


def over_mean(x: str, n: int) -> str:
    """x over its greatest absolute value of the last n rows."""
    top = f"max(abs({x})) OVER {rows(n)}"
    return f"CASE WHEN {top} > 0 THEN greatest(least({x} / ({top} + 1e-10), 1), -1) ELSE 0 END"


def gauge_sql(vol: int = 20, norm: int = 50, eff: int = 15, cool: int = 5) -> str:
    soft = "tanh(greatest(least({}, 20), -20))".format
    part = lambda a, b, d=0: f"coalesce(CASE WHEN {b} <> 0 THEN {a} / {b} END, {d})"
    cooled = lambda name, edge: f"""{name} AS (SELECT symbol, bar_index, {edge} AS ok, CASE WHEN {edge} THEN 0 ELSE -1000000 END AS last FROM sg WHERE bar_index = 0 UNION ALL
SELECT s.symbol, s.bar_index, s.{edge} AND s.bar_index - c.last >= {cool}, CASE WHEN s.{edge} AND s.bar_index - c.last >= {cool} THEN s.bar_index ELSE c.last END FROM {name} c JOIN sg s ON s.symbol = c.symbol AND s.bar_index = c.bar_index + 1)"""  # noqa: E731
    step = f"abs(close - coalesce(lag(close) OVER {LAG}, close))"
    return f"""WITH RECURSIVE {BARS}, {TRUE}, {smooth_sql('ga', 't', 'tr', '(1.0::DOUBLE / 23)')}, {smooth_sql('gu', 'b', 'volume', f'(2.0::DOUBLE / {vol + 1})')},
st AS (SELECT *, {step} AS step FROM t),
u AS (SELECT st.*, CASE WHEN bar_index >= 22 THEN ga.y END AS atr, CASE WHEN bar_index >= {vol - 1} THEN gu.y END AS usual, CASE WHEN bar_index < {eff} THEN 0 ELSE abs(close - lag(close, {eff}) OVER {LAG}) / (sum(step) OVER {rows(eff)} + 1e-10) END AS eff FROM st JOIN ga USING (symbol, bar_index) JOIN gu USING (symbol, bar_index)),
v AS (SELECT *, {part('(2 * close - high - low)', '(high - low)')} AS closing, {part('(least(open, close) + greatest(open, close) - high - low)', '(high - low)')} AS tails, ln(greatest({part('volume', 'usual', 1)}, 1e-10)) AS weight FROM u),
w AS (SELECT *, (closing + 1.47::DOUBLE * tails) * {soft(part('(high - low)', 'atr'))} * {soft(part('volume', 'usual'))} AS shape, 4.14::DOUBLE * {part('atr', 'close')} * (2 * {soft('5.3::DOUBLE * (eff - 0.64::DOUBLE)')} - 1) * closing * {soft('weight')} AS outlook FROM v),
{smooth_sql('gf', 'w', 'shape', '(2.0::DOUBLE / 25)')}, {smooth_sql('gs', 'w', 'shape', '(2.0::DOUBLE / 44)')}, {smooth_sql('go', 'w', 'outlook', '(2.0::DOUBLE / 34)')},
x AS (SELECT w.*, CASE WHEN bar_index >= 42 THEN gf.y - gs.y END AS swing, CASE WHEN bar_index >= 32 THEN go.y END AS mean_outlook FROM w JOIN gf USING (symbol, bar_index) JOIN gs USING (symbol, bar_index) JOIN go USING (symbol, bar_index)),
y AS (SELECT *, {over_mean('swing', norm)} AS pressure, {over_mean('mean_outlook', norm)} AS forecast FROM x),
zz AS (SELECT *, 100 * (0.7::DOUBLE + 0.3::DOUBLE * greatest(least((eff - 0.25::DOUBLE) / 0.35::DOUBLE, 1), 0)) * (0.6::DOUBLE * pressure - 0.3::DOUBLE * forecast + 0.1::DOUBLE * least(abs(weight) / 0.6::DOUBLE, 1) * sign(pressure)) AS raw FROM y),
{smooth_sql('gg', 'zz', 'raw', '(2.0::DOUBLE / 13)')},
val AS (SELECT zz.*, CASE WHEN bar_index >= 11 THEN greatest(least(gg.y, 100), -100) END AS val FROM zz JOIN gg USING (symbol, bar_index)),
cond AS (SELECT *, coalesce(val <= -23 AND val = min(val) OVER {rows(11)} AND (val > lag(val) OVER {LAG} OR (swing < 0 AND swing > lag(swing) OVER {LAG})), false) AS lo,
 coalesce(val >= 36 AND val = max(val) OVER {rows(11)} AND (val < lag(val) OVER {LAG} OR (swing > 0 AND swing < lag(swing) OVER {LAG})), false) AS hi FROM val),
sg AS (SELECT *, lo AND NOT coalesce(lag(lo) OVER {LAG}, false) AS lo_edge, hi AND NOT coalesce(lag(hi) OVER {LAG}, false) AS hi_edge FROM cond),
{cooled('cb', 'lo_edge')}, {cooled('cs', 'hi_edge')}
SELECT symbol, bar_index, round(val, 4) AS main_value, cb.ok AS buy_signal, cs.ok AS sell_signal, round(val / 100, 4) AS combined_signal, round(swing, 4) AS swing, round(forecast, 4) AS forecast, round(eff, 4) AS efficiency FROM sg JOIN cb USING (symbol, bar_index) JOIN cs USING (symbol, bar_index)"""


register("i02_gauge", lambda s, d: shown(indicators.gauge(bars(s, d), vol_len=20, norm_window=50, eff_len=15, cooldown_bars=5), *KEY, *SIGNALS, "swing", "forecast", "efficiency", digits=4), gauge_sql())
register("i03_rsi", lambda s, d: signals(indicators.directional(indicators.generic(bars(s, d), "rsi"))), signal_sql(RSI, "rsi - 50", "rsi", recursive_=True))
register("i04_macd", lambda s, d: signals(indicators.directional(indicators.generic(bars(s, d), "macd"))), signal_sql(MACD, "line - signal", "macd", recursive_=True))
CCI = "CASE WHEN m IS NULL THEN NULL WHEN list_avg(list_transform(l, lambda x: abs(x - m))) = 0 THEN 0 ELSE (tp - m) / (0.015 * list_avg(list_transform(l, lambda x: abs(x - m)))) END"
register("i05_i10_cci_threshold", lambda s, d: signals(indicators.threshold(indicators.generic(bars(s, d), "cci", 20), -20.0, 20.0)), signal_sql(TP, CCI, "u", -20, 20))
register("i06_mfi", lambda s, d: signals(indicators.directional(indicators.generic(bars(s, d), "mfi"))), signal_sql(FLOW, "CASE WHEN n = 14 THEN 100 - 100 / (1 + CASE WHEN neg = 0 THEN 100 ELSE pos / neg END) END - 50", "v"))
ROC = f"t AS (SELECT *, CASE WHEN lag(close, 14) OVER {LAG} = 0 THEN 0 ELSE 100 * (close - lag(close, 14) OVER {LAG}) / lag(close, 14) OVER {LAG} END AS x FROM b)"
register("i07_i09_roc_smoothed", lambda s, d: signals(indicators.directional(indicators.finish(indicators.generic(bars(s, d), "roc"), 5, 1.5))), signal_sql(ROC, f"({sql.sma('x', 5)}) * 1.5", "t"))

# Walk-forward evaluation of the smoothed rate of change.

HORIZONS = [1, 3, 6]
FOLDS = dict(n_folds=2, embargo=5, min_test=30)
BASE = f"{ROC}, m AS (SELECT *, {sql.sma('x', 5)} AS m FROM t), g AS (SELECT *, CASE WHEN m IS NULL OR max(abs(m)) OVER {CUM} = 0 THEN 0 ELSE greatest(least(m / max(abs(m)) OVER {CUM}, 1), -1) END AS score0, coalesce(lag(m) OVER {LAG} <= 0 AND m > 0, false) AS buy_signal, coalesce(lag(m) OVER {LAG} >= 0 AND m < 0, false) AS sell_signal FROM m)"


def fold_cte(n: int, embargo: int, least: int) -> str:
    return f"""sizes AS (SELECT symbol, "interval", count(*) AS n, count(*) // {n} AS size FROM b GROUP BY ALL),
f0 AS (SELECT *, CAST(floor(size * 0.6::DOUBLE) AS BIGINT) AS tr FROM sizes),
f1 AS (SELECT *, CASE WHEN size - tr - {embargo} < {least} THEN size - {least} - {embargo} ELSE tr END AS train, CASE WHEN size - tr - {embargo} < {least} THEN {least} ELSE size - tr - {embargo} END AS test FROM f0),
folds AS (SELECT symbol, "interval", CAST(fold AS INT) AS fold, fold * size AS train_start, fold * size + train AS train_end, fold * size + train + {embargo} AS test_start, least(fold * size + train + {embargo} + test, n) AS test_end
 FROM f1, range({n}) r(fold) WHERE fold * size + train + {embargo} < least(fold * size + train + {embargo} + test, n))"""


def label_cte(horizons: list[int]) -> str:
    each = " UNION ALL ".join(f"SELECT *, {h} AS horizon, CASE WHEN close <> 0 THEN (lead(close, {h}) OVER {LAG} - close) / close * 100 END AS forward_return FROM g" for h in horizons)
    return f"""hz AS ({each}), lab AS (SELECT hz.*, f.fold, f.train_end, f.test_start, CASE WHEN bar_index >= train_start AND bar_index < train_end THEN 'train' ELSE 'test' END AS part, round(score0, 9) AS score, CAST(forward_return > 0 AS INT) AS label
 FROM hz JOIN folds f USING (symbol, "interval") WHERE ((bar_index >= train_start AND bar_index < train_end) OR (bar_index >= test_start AND bar_index < test_end)) AND forward_return IS NOT NULL AND forward_return <> 0)"""


FOLD_SQL, LABEL_SQL = fold_cte(2, 5, 30), label_cte(HORIZONS)
ALL_SQL = f"WITH {BARS}, {BASE}, {FOLD_SQL}, {LABEL_SQL}"


def example(spark, sf_dir) -> DataFrame:
    return indicators.directional(indicators.finish(indicators.generic(bars(spark, sf_dir), "roc"), 5))


def example_labels(spark, sf_dir) -> DataFrame:
    b = example(spark, sf_dir)
    return backtest.labels(backtest.in_folds(backtest.by_horizon(b, HORIZONS), backtest.folds(b, **FOLDS)), F.round("combined_signal", 9))


MCC = "CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END"
register("a01_folds", lambda s, d: backtest.folds(bars(s, d), **FOLDS).drop("interval"), f'WITH {BARS}, {FOLD_SQL} SELECT symbol, fold, train_start, train_end, test_start, test_end FROM folds')
register("a03_j07_forward_returns", lambda s, d: shown(backtest.by_horizon(bars(s, d), HORIZONS), *KEY, "horizon", "forward_return"), f"WITH {BARS}, g AS (SELECT * FROM b), " + LABEL_SQL.split(", lab AS")[0] + " SELECT symbol, bar_index, horizon, round(forward_return, 6) AS forward_return FROM hz")
register("a04_j06_labels", lambda s, d: shown(example_labels(s, d), *KEY, "fold", "part", "horizon", "label", "score", digits=4), ALL_SQL + " SELECT symbol, bar_index, fold, part, horizon, label, round(score, 4) AS score FROM lab")


def mcc_by_horizon(spark, sf_dir) -> DataFrame:
    x = example_labels(spark, sf_dir).groupBy("symbol", "horizon").agg(*backtest.confusion(F.col("label"), F.col("score") >= 0))
    return x.withColumn("mcc", F.round(backtest.mcc(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")), 6))


COUNTS = "count(*) FILTER (label = 1 AND score >= {t}) AS tp, count(*) FILTER (label = 0 AND score >= {t}) AS fp, count(*) FILTER (label = 0 AND score < {t}) AS tn, count(*) FILTER (label = 1 AND score < {t}) AS fn"
register("a05_a06_mcc", mcc_by_horizon, ALL_SQL + f", k AS (SELECT symbol, horizon, {COUNTS.format(t=0)} FROM lab GROUP BY ALL) SELECT *, round({MCC}, 6) AS mcc FROM k")
AUC = "(SELECT {k}, CASE WHEN count(*) FILTER (label = 1) = 0 OR count(*) FILTER (label = 0) = 0 THEN 0.5 ELSE (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE END AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS rk FROM {t}) GROUP BY {k})"
register("a07_roc_auc", lambda s, d: shown(backtest.roc_auc(example_labels(s, d), ["symbol", "horizon"]), "symbol", "horizon", "roc_auc"), ALL_SQL + " SELECT symbol, horizon, round(roc_auc, 6) AS roc_auc FROM " + AUC.format(k="symbol, horizon", t="lab"))
THRESHOLD = f"""safe AS (SELECT * FROM lab WHERE part = 'train' AND bar_index < least(train_end, test_start) - horizon),
byscore AS (SELECT symbol, fold, horizon, score, sum(label) AS p, sum(1 - label) AS q FROM safe GROUP BY ALL),
cums AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER e - sum(p) OVER w AS fn, sum(q) OVER e - sum(q) OVER w AS tn FROM byscore WINDOW w AS (PARTITION BY symbol, fold, horizon ORDER BY score DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY symbol, fold, horizon)),
scan AS (SELECT *, round({MCC}, 12) AS mcc FROM cums),
best AS (SELECT symbol, fold, horizon, CASE WHEN max(mcc) <= 0 THEN max(score) + 1e-9 ELSE arg_max(score, (mcc, score)) END AS threshold, greatest(max(mcc), 0) AS train_mcc FROM scan GROUP BY ALL)"""


def thresholds(spark, sf_dir) -> DataFrame:
    x = example_labels(spark, sf_dir)
    safe = x.where((F.col("part") == "train") & (F.col("bar_index") < F.least("train_end", "test_start") - F.col("horizon")))
    return backtest.best_threshold(safe, ["symbol", "interval", "fold", "horizon"])


register("a08_a09_best_threshold", lambda s, d: shown(thresholds(s, d), "symbol", "fold", "horizon", "threshold", "train_mcc"), ALL_SQL + f", {THRESHOLD} SELECT symbol, fold, horizon, round(threshold, 6) AS threshold, round(train_mcc, 6) AS train_mcc FROM best")
CHOSEN = "chosen AS (SELECT symbol, fold, arg_max(horizon, (train_mcc, -horizon)) AS horizon, max(train_mcc) AS train_mcc, arg_max(threshold, (train_mcc, -horizon)) AS threshold FROM best GROUP BY ALL)"
register("a10_best_horizon", lambda s, d: shown(backtest.best_horizon(thresholds(s, d), ["symbol", "fold"]), "symbol", "fold", "horizon", "train_mcc"), ALL_SQL + f", {THRESHOLD}, {CHOSEN} SELECT symbol, fold, horizon, round(train_mcc, 6) AS train_mcc FROM chosen")


def evaluated(spark, sf_dir) -> DataFrame:
    b = example(spark, sf_dir).withColumn("combined_signal", F.round("combined_signal", 9))
    return shown(backtest.evaluate(b, HORIZONS, min_train=1, **FOLDS), "symbol", "fold", "horizon", "samples", "tp", "fp", "tn", "fn", "mcc", "roc_auc")


EVALUATED = ALL_SQL + f""", {THRESHOLD}, {CHOSEN}, tests AS (SELECT l.*, c.threshold FROM lab l JOIN chosen c USING (symbol, fold, horizon) WHERE part = 'test'),
k AS (SELECT symbol, fold, horizon, count(*) AS samples, {COUNTS.format(t='threshold')} FROM tests GROUP BY ALL)
SELECT k.*, round({MCC}, 6) AS mcc, round(a.roc_auc, 6) AS roc_auc FROM k JOIN {AUC.format(k='symbol, fold', t='tests')} a USING (symbol, fold)"""
register("a20_j11_walk_forward", evaluated, EVALUATED)
TRADE_SQL = f"""x AS (SELECT *, lead(close, 6) OVER {LAG} AS exit_price FROM g), trades AS (
SELECT symbol, bar_index AS entry_bar, bar_index + 6 AS exit_bar, 'long' AS direction, close AS entry_price, exit_price, (exit_price - close) / close * 100 AS return_pct FROM x WHERE buy_signal AND exit_price IS NOT NULL
UNION ALL SELECT symbol, bar_index, bar_index + 6, 'short', close, exit_price, -(exit_price - close) / close * 100 FROM x WHERE sell_signal AND exit_price IS NOT NULL)"""
register("a11_a12_j02_trades", lambda s, d: shown(backtest.trades(example(s, d), 6), "symbol", "entry_bar", "exit_bar", "direction", "entry_price", "exit_price", "return_pct"),
         f"WITH {BARS}, {BASE}, {TRADE_SQL} SELECT symbol, entry_bar, exit_bar, direction, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(return_pct, 6) AS return_pct FROM trades")
METRICS = ("symbol", "total_trades", "wins", "total_return", "avg_return", "win_rate", "profit_factor", "sharpe", "max_drawdown")
METRIC_SQL = f"""WITH {BARS}, {BASE}, {TRADE_SQL}, e AS (SELECT *, 100 * exp(sum(ln(greatest(1 + return_pct / 100, 1e-12))) OVER (PARTITION BY symbol ORDER BY entry_bar, direction ROWS UNBOUNDED PRECEDING)) AS equity FROM trades),
d AS (SELECT *, (equity / max(equity) OVER (PARTITION BY symbol ORDER BY entry_bar, direction ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM e)
SELECT symbol, count(*) AS total_trades, count(*) FILTER (return_pct > 0) AS wins, round(sum(return_pct), 6) AS total_return, round(avg(return_pct), 6) AS avg_return, round(count(*) FILTER (return_pct > 0) / count(*)::DOUBLE, 6) AS win_rate,
round(CASE WHEN sum(least(return_pct, 0)) < 0 THEN sum(greatest(return_pct, 0)) / -sum(least(return_pct, 0)) WHEN sum(greatest(return_pct, 0)) > 0 THEN 10 ELSE 0 END, 6) AS profit_factor,
round(CASE WHEN count(*) > 1 AND stddev_pop(return_pct) > 0 THEN avg(return_pct) / stddev_pop(return_pct) * sqrt(8760.0::DOUBLE) ELSE 0 END, 6) AS sharpe, round(least(100, abs(min(dd))), 6) AS max_drawdown FROM d GROUP BY symbol"""
register("a13_a16_trade_metrics", lambda s, d: shown(backtest.trade_metrics(backtest.trades(example(s, d), 6), ["symbol"]), *METRICS), METRIC_SQL)


def accuracy(spark, sf_dir) -> DataFrame:
    x = example_labels(spark, sf_dir).where("buy_signal OR sell_signal")
    hit = F.when(F.col("buy_signal"), F.col("label") == 1).otherwise(F.col("label") == 0)
    return x.groupBy("symbol", "horizon").agg(F.round(F.count_if(hit) / F.count("*"), 6).alias("accuracy"), F.count("*").alias("n"))


register("a17_directional_accuracy", accuracy, ALL_SQL + " SELECT symbol, horizon, round(count(*) FILTER (CASE WHEN buy_signal THEN label = 1 ELSE label = 0 END) / count(*)::DOUBLE, 6) AS accuracy, count(*) AS n FROM lab WHERE buy_signal OR sell_signal GROUP BY ALL")


def tails(spark, sf_dir) -> DataFrame:
    """F1 of strong signals against extreme test moves, with the limits of the training rows."""
    x = example_labels(spark, sf_dir).where("horizon = 3")
    cut = x.where("part = 'train'").groupBy("symbol", "fold").agg(
        F.percentile("forward_return", F.lit(0.8)).alias("p80"), F.percentile("forward_return", F.lit(0.2)).alias("p20"), F.greatest(F.lit(0.1), F.percentile(F.abs("score"), F.lit(0.75))).alias("strength")
    )
    t = x.where("part = 'test'").join(cut, ["symbol", "fold"])
    move, said = F.when(F.col("forward_return") >= F.col("p80"), 1).when(F.col("forward_return") <= F.col("p20"), -1).otherwise(0), F.when(F.col("score") >= F.col("strength"), 1).when(F.col("score") <= -F.col("strength"), -1).otherwise(0)
    hit = F.count_if((move != 0) & (move == said))
    return t.groupBy("symbol", "fold").agg(hit.alias("hits"), F.round(F.coalesce(F.try_divide(2.0 * hit, F.count_if(move != 0) + F.count_if(said != 0)), F.lit(0.0)), 6).alias("f1"))


register("a18_tail_capture", tails, ALL_SQL + """, c AS (SELECT symbol, fold, quantile_cont(forward_return, 0.8) AS p80, quantile_cont(forward_return, 0.2) AS p20, greatest(0.1, quantile_cont(abs(score), 0.75)) AS strength FROM lab WHERE horizon = 3 AND part = 'train' GROUP BY ALL),
t2 AS (SELECT symbol, fold, CASE WHEN forward_return >= p80 THEN 1 WHEN forward_return <= p20 THEN -1 ELSE 0 END AS mv, CASE WHEN score >= strength THEN 1 WHEN score <= -strength THEN -1 ELSE 0 END AS said FROM lab JOIN c USING (symbol, fold) WHERE horizon = 3 AND part = 'test')
SELECT symbol, fold, count(*) FILTER (mv <> 0 AND mv = said) AS hits, round(coalesce(2.0 * count(*) FILTER (mv <> 0 AND mv = said) / nullif(count(*) FILTER (mv <> 0) + count(*) FILTER (said <> 0), 0), 0), 6) AS f1 FROM t2 GROUP BY ALL""")


def autocorrelations(spark, sf_dir) -> DataFrame:
    x = bars(spark, sf_dir).withColumn("ret", series.roc(F.col("close"), 1)).where("ret IS NOT NULL")
    out = stats.autocorrelation(x, "ret", ["symbol"], "timestamp")
    return shown(out.withColumn("effective", stats.effective_size(F.col("n"), F.col("rho"))), "symbol", "n", "rho", "effective")


RETS = f"q AS (SELECT *, CASE WHEN lag(close) OVER {LAG} = 0 THEN 0 ELSE 100 * (close - lag(close) OVER {LAG}) / lag(close) OVER {LAG} END AS ret FROM b), qq AS (SELECT *, ret - avg(ret) OVER (PARTITION BY symbol) AS dv FROM q WHERE ret IS NOT NULL)"
register("a21_a22_autocorrelation", autocorrelations, f"WITH {BARS}, {RETS}, p AS (SELECT *, lag(dv) OVER {LAG} AS pv FROM qq), z AS (SELECT symbol, count(*) AS n, avg(dv * pv) / var_pop(ret) AS rho FROM p GROUP BY symbol) SELECT symbol, n, round(rho, 6) AS rho, round(greatest(3, n * (1 - rho) / (1 + rho)), 6) AS effective FROM z")


def regime_metrics(spark, sf_dir) -> DataFrame:
    x = bars(spark, sf_dir).withColumn("ret", series.roc(F.col("close"), 1))
    x = backtest.regimes(x, F.round(series.trailing_volatility(F.col("ret"), 10, 4.0), 6), ["symbol"]).where("regime IS NOT NULL")
    sd = F.stddev_pop("ret")
    return shown(x.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), sd.alias("deviation"), (F.count_if(F.col("ret") > 0) / F.count("*")).alias("win_rate")), "symbol", "regime", "n", "mean", "deviation", "win_rate", digits=4)


register("a23_a25_regimes", regime_metrics, f"""WITH {BARS}, q AS (SELECT *, CASE WHEN lag(close) OVER {LAG} = 0 THEN 0 ELSE 100 * (close - lag(close) OVER {LAG}) / lag(close) OVER {LAG} END AS ret FROM b),
v AS (SELECT *, round(CASE WHEN bar_index >= 10 THEN stddev_pop(ret) OVER ({O} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) * sqrt(2190.0::DOUBLE) END, 6) AS vol FROM q),
c AS (SELECT symbol, quantile_cont(vol, 0.33) AS p33, quantile_cont(vol, 0.67) AS p67 FROM v GROUP BY symbol)
SELECT symbol, CASE WHEN vol <= p33 THEN 'low' WHEN vol <= p67 THEN 'medium' ELSE 'high' END AS regime, count(*) AS n, round(avg(ret), 4) AS mean, round(stddev_pop(ret), 4) AS deviation, round(count(*) FILTER (ret > 0) / count(*)::DOUBLE, 4) AS win_rate
FROM v JOIN c USING (symbol) WHERE vol IS NOT NULL GROUP BY ALL""")


def box(spark, sf_dir) -> DataFrame:
    x = bars(spark, sf_dir).withColumn("ret", series.roc(F.col("close"), 1)).where("ret IS NOT NULL")
    rho = stats.lag_correlations(x, "ret", ["symbol"], "timestamp", 3)
    q, p = stats.ljung_box([F.col(f"rho{k}") for k in (1, 2, 3)], F.col("n"))
    return shown(rho.withColumns({"q": q, "p": p}), "symbol", "q", "p", digits=4)


register("a26_ljung_box", box, f"""WITH {BARS}, {RETS}, p AS (SELECT *, lag(dv) OVER {LAG} AS p1, lag(dv, 2) OVER {LAG} AS p2, lag(dv, 3) OVER {LAG} AS p3 FROM qq),
z AS (SELECT symbol, count(*) AS n, sum(dv * p1) / (count(*) * var_pop(ret)) AS r1, sum(dv * p2) / (count(*) * var_pop(ret)) AS r2, sum(dv * p3) / (count(*) * var_pop(ret)) AS r3 FROM p GROUP BY symbol),
s AS (SELECT symbol, n * (n + 2) * (r1 * r1 / (n - 1) + r2 * r2 / (n - 2) + r3 * r3 / (n - 3)) AS q FROM z)
SELECT symbol, round(q, 4) AS q, round(1 - 0.5 * (1 + tanh(0.79788::DOUBLE * (cbrt(q / 3) - (1 - 2 / 27.0::DOUBLE)) / sqrt(2 / 27.0::DOUBLE))), 4) AS p FROM s""")


def test_counts(spark, sf_dir) -> DataFrame:
    m = mcc_by_horizon(spark, sf_dir)
    return m.withColumn("test_id", F.xxhash64("symbol", "horizon").bitwiseAND(F.lit((1 << 31) - 1))).select("symbol", "horizon", "test_id", "tp", "fp", "tn", "fn", "mcc")


register("a27_permutation_test", lambda s, d: stats.permutation_test(test_counts(s, d)))
register("a28_permutation_auc", lambda s, d: stats.permutation_test_auc(example_labels(s, d), ["symbol", "horizon"]))
register("a29_a30_bootstrap", lambda s, d: stats.comprehensive_test(test_counts(s, d)))
register("a29_bootstrap_bca", lambda s, d: stats.bootstrap_interval(test_counts(s, d), method="bca"))


def p_values(spark, sf_dir) -> DataFrame:
    """A p value for each symbol and horizon from the MCC, by the coarse normal distribution."""
    m = mcc_by_horizon(spark, sf_dir).withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    p = F.round(1 - 0.5 * (1 + F.tanh(0.79788 * F.col("mcc") * F.sqrt(F.col("n").cast("double")))), 8)
    return m.withColumn("p", p).withColumn("test_id", F.col("horizon"))


P_SQL = ALL_SQL + f", k AS (SELECT symbol, horizon, {COUNTS.format(t=0)} FROM lab GROUP BY ALL), mm AS (SELECT *, round({MCC}, 6) AS mcc, tp + fp + tn + fn AS n FROM k), pv AS (SELECT *, round(1 - 0.5 * (1 + tanh(0.79788 * mcc * sqrt(n::DOUBLE))), 8) AS p FROM mm)"
register("a31_a33_corrections", lambda s, d: shown(stats.corrections(p_values(s, d), ["symbol"]), "symbol", "horizon", "p", "bonferroni", "benjamini_hochberg", "holm"),
         P_SQL + """, rk AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS nn, row_number() OVER (PARTITION BY symbol ORDER BY p, horizon) AS rn FROM pv)
SELECT symbol, horizon, round(p, 6) AS p, round(least(p * nn, 1), 6) AS bonferroni, round(least(min(p * nn / rn) OVER (PARTITION BY symbol ORDER BY p, horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS benjamini_hochberg,
round(least(max(p * (nn - rn + 1)) OVER (PARTITION BY symbol ORDER BY p, horizon ROWS UNBOUNDED PRECEDING), 1), 6) AS holm FROM rk""")  # fmt: skip


def effects(spark, sf_dir) -> DataFrame:
    m = p_values(spark, sf_dir)
    low, high = stats.mcc_interval(F.col("mcc"), F.col("n"))
    m = m.select("*", low, high).join(backtest.roc_auc(example_labels(spark, sf_dir), ["symbol", "horizon"]), ["symbol", "horizon"])
    m = m.withColumn("detectable", stats.detectable_effect(F.col("n"))).withColumn("needed", stats.samples_needed(F.greatest(F.abs("mcc"), F.lit(0.01))))
    composite = stats.composite_objective(F.col("mcc"), F.round("roc_auc", 6), F.lit(0.5), F.lit(0.2), F.col("n"))
    m = m.withColumn("composite", F.when(composite > float("-inf"), composite))
    score = stats.objective(F.col("mcc"), F.round("roc_auc", 6), F.col("n"), F.lit(0.4), F.lit(0.01))
    return shown(m.withColumn("objective", F.when(score > float("-inf"), score)), "symbol", "horizon", "n", "ci_low", "ci_high", "detectable", "needed", "composite", "objective")


Z, ZZ = "1.959963984540054::DOUBLE", "2.8015852181129683::DOUBLE"
register("a34_a38_effects_and_objectives", effects, P_SQL + f""", a AS (SELECT * FROM {AUC.format(k='symbol, horizon', t='lab')}), j AS (SELECT pv.*, round(a.roc_auc, 6) AS auc FROM pv JOIN a USING (symbol, horizon))
SELECT symbol, horizon, n, round(tanh(atanh(mcc) - {Z} / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(mcc) + {Z} / sqrt(n - 3)), 6) AS ci_high, round(tanh({ZZ} / sqrt(n - 3)), 6) AS detectable,
CAST(greatest(ceil(power({ZZ} / atanh(greatest(abs(mcc), 0.01)), 2)) + 3, 30) AS BIGINT) AS needed, round(CASE WHEN n >= 100 THEN 0.5 * (mcc + 1) / 2 + 0.2 * greatest(0, (auc - 0.5) / 0.5) + 0.15 * 0.5 + 0.15 * 0.2 END, 6) AS composite,
round(CASE WHEN n < 100 OR auc < 0.5 OR mcc < 0.02 THEN NULL ELSE (n / (n + 50.0::DOUBLE) * mcc + (1 - n / (n + 50.0::DOUBLE)) * 0.03) * (1 - 0.1 * (0.5 - 0.4)) END, 6) AS objective FROM j""")


# Roll-ups of folds and series.


def fold_rows(spark, sf_dir, discrete: bool = True) -> DataFrame:
    b = example(spark, sf_dir).withColumn("combined_signal", F.round("combined_signal", 9))
    return backtest.fold_metrics(b, HORIZONS, min_train=1, discrete=discrete, interval_hours=4.0, **FOLDS)


ROUGH = ("fold", "horizon", "samples", "tp", "fp", "tn", "fn", "mcc", "roc_auc", "accuracy", "total_trades", "wins", "total_return", "profit_factor", "max_drawdown")


def fold_sql(discrete: bool) -> str:
    said = ("buy_signal", "sell_signal") if discrete else ("score1 > 0.3", "score1 < -0.3")
    entry = said if discrete else ("score1 > 0.3 AND before <= 0.3", "score1 < -0.3 AND before >= -0.3")
    return ALL_SQL + f""", {THRESHOLD}, {CHOSEN}, al AS (SELECT hz.*, f.fold, round(score0, 9) AS score1, lag(round(score0, 9), 1, 0) OVER (PARTITION BY symbol, f.fold, horizon ORDER BY bar_index) AS before FROM hz JOIN folds f USING (symbol, "interval") WHERE bar_index >= test_start AND bar_index < test_end),
tests AS (SELECT l.*, c.threshold FROM lab l JOIN chosen c USING (symbol, fold, horizon) WHERE part = 'test'),
k AS (SELECT symbol, fold, horizon, threshold, count(*) AS samples, {COUNTS.format(t='threshold')} FROM tests GROUP BY ALL),
kn AS (SELECT al.* FROM al JOIN chosen c USING (symbol, fold, horizon) WHERE forward_return IS NOT NULL),
ac AS (SELECT symbol, fold, CASE WHEN count(*) FILTER ({said[0]} OR {said[1]}) > 0 THEN count(*) FILTER (({said[0]} AND forward_return > 0) OR ({said[1]} AND forward_return < 0)) / count(*) FILTER ({said[0]} OR {said[1]})::DOUBLE ELSE 0.5 END AS accuracy FROM kn GROUP BY ALL),
td AS (SELECT symbol, fold, bar_index, 'long' AS direction, forward_return AS r FROM kn WHERE {entry[0]} UNION ALL SELECT symbol, fold, bar_index, 'short', -forward_return FROM kn WHERE {entry[1]}),
eq AS (SELECT *, 100 * exp(sum(ln(greatest(1 + r / 100, 1e-12))) OVER (PARTITION BY symbol, fold ORDER BY bar_index, direction ROWS UNBOUNDED PRECEDING)) AS equity FROM td),
dr AS (SELECT *, (equity / max(equity) OVER (PARTITION BY symbol, fold ORDER BY bar_index, direction ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM eq),
tm AS (SELECT symbol, fold, count(*) AS total_trades, count(*) FILTER (r > 0) AS wins, sum(r) AS total_return, CASE WHEN sum(least(r, 0)) < 0 THEN sum(greatest(r, 0)) / -sum(least(r, 0)) WHEN sum(greatest(r, 0)) > 0 THEN 10 ELSE 0 END AS profit_factor, least(100, abs(min(dd))) AS max_drawdown FROM dr GROUP BY ALL),
fm AS (SELECT k.*, {MCC} AS mcc, a.roc_auc, coalesce(accuracy, 0.5) AS accuracy, coalesce(total_trades, 0) AS total_trades, coalesce(wins, 0) AS wins, coalesce(total_return, 0) AS total_return, coalesce(profit_factor, 0) AS profit_factor, coalesce(max_drawdown, 0) AS max_drawdown
 FROM k JOIN {AUC.format(k='symbol, fold', t='tests')} a USING (symbol, fold) LEFT JOIN ac USING (symbol, fold) LEFT JOIN tm USING (symbol, fold))"""


ROUGH_SQL = "symbol, fold, horizon, samples, tp, fp, tn, fn, total_trades, wins, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mcc", "roc_auc", "accuracy", "total_return", "profit_factor", "max_drawdown"))
for name, mode in (("a12_a17_fold_metrics", True), ("a11_a17_directional", False)):
    register(name, lambda s, d, mode=mode: shown(fold_rows(s, d, mode), "symbol", *ROUGH, digits=4), fold_sql(mode) + f" SELECT {ROUGH_SQL} FROM fm")
STEADY = "CASE WHEN avg({x}) FILTER (total_trades > 0) > 0 THEN 1 / (1 + stddev_pop({x}) FILTER (total_trades > 0) / avg({x}) FILTER (total_trades > 0)) ELSE 0 END"
SUMS_SQL = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(wins) AS BIGINT) AS wins, sum(roc_auc * samples) / sum(samples) AS roc_auc, CAST(floor(median(horizon)) AS INT) AS horizon, median(threshold) AS threshold"
ROLL = fold_sql(True) + f""", ru AS (SELECT symbol, count(*) AS folds, {SUMS_SQL}, avg(accuracy) AS accuracy, sum(total_return) AS total_return, max(max_drawdown) AS max_drawdown, avg(profit_factor) AS profit_factor,
({STEADY.format(x='profit_factor')} + {STEADY.format(x='accuracy')}) / 2 AS consistency FROM fm GROUP BY symbol), rr AS (SELECT *, {MCC} AS mcc, CASE WHEN roc_auc > 0.5 THEN (roc_auc - 0.5) / 0.5 * 100 ELSE 0 END AS improvement FROM ru)"""
ROLLED = ("horizon", "samples", "tp", "fp", "tn", "fn", "total_trades", "wins", "mcc", "roc_auc", "threshold", "accuracy", "total_return", "max_drawdown", "profit_factor", "consistency", "improvement")
REALS = ("mcc", "roc_auc", "threshold", "accuracy", "total_return", "max_drawdown", "profit_factor", "consistency", "improvement")
REALS_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in REALS)
register("a19_a20_roll_up", lambda s, d: shown(backtest.roll_up(fold_rows(s, d), ["symbol"]), "symbol", "folds", *ROLLED, digits=4), ROLL + f" SELECT symbol, folds, horizon, samples, tp, fp, tn, fn, total_trades, wins, {REALS_SQL} FROM rr")


def two_halves(spark, sf_dir) -> DataFrame:
    """Series rows in two groups, by the length of the symbol's name."""
    return backtest.roll_up(fold_rows(spark, sf_dir), ["symbol"]).withColumn("half", F.length("symbol") % 2)


register("a40_across_symbols", lambda s, d: shown(backtest.across_symbols(two_halves(s, d), ["half"]), "half", "series", *ROLLED, digits=4),
         ROLL + f", ag AS (SELECT length(symbol)::INT % 2 AS half, count(*) AS series, min(mcc) AS worst, {SUMS_SQL}, avg(accuracy) AS accuracy, avg(total_return) AS total_return, avg(profit_factor) AS profit_factor, avg(consistency) AS consistency, avg(improvement) AS improvement, max(max_drawdown) AS max_drawdown FROM rr WHERE total_trades > 0 GROUP BY half), mm AS (SELECT *, {MCC} AS mcc FROM ag WHERE worst >= -0.1) SELECT half, series, horizon, samples, tp, fp, tn, fn, total_trades, wins, {REALS_SQL} FROM mm")
register("a41_average_objective", lambda s, d: shown(backtest.average_objective(two_halves(s, d), ["half"], F.when(F.col("mcc") > -0.05, F.col("mcc"))).withColumn("rejected", F.col("objective") == float("-inf")).withColumn("objective", F.when(~F.col("rejected"), F.col("objective"))), "half", "objective", "rejected", digits=4),
         ROLL + " SELECT length(symbol)::INT % 2 AS half, CASE WHEN min(mcc) > -0.05 THEN round(avg(mcc), 4) END AS objective, min(mcc) <= -0.05 AS rejected FROM rr GROUP BY half")
register("a42_data_usage", lambda s, d: backtest.data_usage(backtest.folds(bars(s, d), **FOLDS)).drop("interval"),
         f"WITH {BARS}, {FOLD_SQL} SELECT symbol, count(*) AS folds, CAST(sum(train_end - train_start) AS BIGINT) AS train_bars, CAST(sum(test_end - test_start) AS BIGINT) AS test_bars, max(test_end) AS last_bar, false AS overlap, min(test_start - train_end) AS least_gap FROM folds GROUP BY symbol")
