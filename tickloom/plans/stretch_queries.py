"""Queries of as-of joins, order statistics, moving regressions, the stop-and-reverse series, audits
of folds and regimes of trades, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import series
from tickloom.operators import asof, audit, backtest, fold, stats
from tickloom.plans.evaluation_queries import BASE, ROLL, TRADE_SQL, example, fold_rows
from tickloom.plans.registry import register
from tickloom.plans.series_queries import bars
from tickloom.plans.sql import BARS, LAG, O, over_bars, rows
from tickloom.sources import bars as source


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def daily_of_all(spark, sf_dir: str) -> DataFrame:
    """4-hour bars with the close of their own symbol's day, and with that of all events' last hour."""
    own = asof.security(bars(spark, sf_dir), source.event_bars(spark, sf_dir, "1d"), None, {"day_close": "close"}, 7 * 86400)
    both = asof.security(own, source.event_bars(spark, sf_dir, "1h", by_type=False), "ALL", {"hour_close": "close", "hour_high": "high"}, 7 * 86400)
    return rounded(both, "symbol", "bar_index", "day_close", "hour_close", "hour_high")


def other_bars(name: str, unit: str, symbol: str) -> str:
    return f"{name} AS (SELECT {symbol} AS symbol, time_bucket(INTERVAL '{unit}', ts) + INTERVAL '{unit}' AS done, arg_max(value, ts) AS close, max(value) AS high FROM events GROUP BY ALL)"


register(
    "security_as_of",
    daily_of_all,
    f"""WITH {BARS}, {other_bars('days', '1 day', 'event_type')}, {other_bars('hours', '1 hour', "'ALL'")},
e AS (SELECT *, "timestamp" + INTERVAL '4 hours' AS done FROM b)
SELECT e.symbol, bar_index, round(days.close, 6) AS day_close, round(hours.close, 6) AS hour_close, round(hours.high, 6) AS hour_high
FROM e ASOF LEFT JOIN days ON e.symbol = days.symbol AND e.done >= days.done ASOF LEFT JOIN hours ON e.done >= hours.done""",
)
BEFORE = f"({O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
register(
    "percentrank",
    lambda s, d: rounded(bars(s, d).withColumn("rank", series.percentrank(F.col("close"), 20)), "symbol", "bar_index", "rank"),
    over_bars("round(CASE WHEN len(l) = 20 THEN 100.0::DOUBLE * len(list_filter(l, lambda v: v <= close)) / 20 END, 6) AS rank", f"t AS (SELECT *, list(close) OVER {BEFORE} AS l FROM b)", "t"),
)
register(
    "correlation",
    lambda s, d: rounded(bars(s, d).withColumn("r", series.correlation(F.col("close"), F.col("volume"), 20)), "symbol", "bar_index", "r"),
    over_bars(f"round(CASE WHEN count(*) OVER {rows(20)} = 20 THEN corr(close, volume) OVER {rows(20)} END, 6) AS r"),
)
_LINE = f"regr_intercept(close, bar_index) OVER {rows(14)} + regr_slope(close, bar_index) OVER {rows(14)} * (bar_index - {{back}})"
register(
    "linreg",
    lambda s, d: rounded(bars(s, d).withColumns({"at_end": series.linreg(F.col("close"), 14), "two_back": series.linreg(F.col("close"), 14, 2)}), "symbol", "bar_index", "at_end", "two_back", digits=4),
    over_bars(", ".join(f"round(CASE WHEN bar_index >= 13 THEN {_LINE.format(back=k)} END, 4) AS {n}" for n, k in (("at_end", 0), ("two_back", 2)))),
)


def with_aroon(spark, sf_dir: str) -> DataFrame:
    up, down = series.aroon(F.col("high"), F.col("low"), 14)
    return rounded(bars(spark, sf_dir).withColumns({"up": up, "down": down}), "symbol", "bar_index", "up", "down")


register(
    "aroon",
    with_aroon,
    over_bars(
        "CASE WHEN bar_index >= 14 THEN round(100.0::DOUBLE * (14 - (bar_index - top.i)) / 14, 6) END AS up, CASE WHEN bar_index >= 14 THEN round(100.0::DOUBLE * (14 - (bar_index - low_.i)) / 14, 6) END AS down",
        f"t AS (SELECT *, max({{'x': high, 'i': bar_index}}) OVER {rows(15)} AS top, max({{'x': -low, 'i': bar_index}}) OVER {rows(15)} AS low_ FROM b)",
        "t",
    ),
)
SAR = f"""
WITH RECURSIVE {BARS}, p AS (
  SELECT *, lag(close) OVER {LAG} AS was, lag(high) OVER {LAG} AS h1, lag(high, 2) OVER {LAG} AS h2, lag(low) OVER {LAG} AS l1, lag(low, 2) OVER {LAG} AS l2 FROM b
), s AS (
  SELECT symbol, 0::BIGINT AS bar_index, false AS up, 0::DOUBLE AS ext, 0::DOUBLE AS acc, 0::DOUBLE AS sar FROM p WHERE bar_index = 0
  UNION ALL
  SELECT symbol, bar_index, up <> turn, CASE WHEN turn THEN CASE WHEN up THEN low ELSE high END ELSE further END,
         CASE WHEN turn OR first THEN 0.02::DOUBLE WHEN further <> ext THEN least(acc + 0.02::DOUBLE, 0.2::DOUBLE) ELSE acc END,
         CASE WHEN up <> turn THEN least(base, l1, coalesce(l2, l1)) ELSE greatest(base, h1, coalesce(h2, h1)) END
  FROM (
    SELECT *, CASE WHEN turn THEN CASE WHEN up THEN greatest(high, ext) ELSE least(low, ext) END ELSE moved END AS base,
           CASE WHEN first THEN ext WHEN up THEN greatest(ext, high) ELSE least(ext, low) END AS further
    FROM (
      SELECT *, (up AND moved > low) OR (NOT up AND moved < high) AS turn
      FROM (
        SELECT *, from_ + acc * (ext - from_) AS moved
        FROM (
          SELECT p.*, p.bar_index = 1 AS first, CASE WHEN p.bar_index = 1 THEN p.close > p.was ELSE s.up END AS up,
                 CASE WHEN p.bar_index > 1 THEN s.ext WHEN p.close > p.was THEN p.high ELSE p.low END AS ext,
                 CASE WHEN p.bar_index > 1 THEN s.acc ELSE 0.02::DOUBLE END AS acc,
                 CASE WHEN p.bar_index > 1 THEN s.sar WHEN p.close > p.was THEN p.l1 ELSE p.h1 END AS from_
          FROM s JOIN p ON p.symbol = s.symbol AND p.bar_index = s.bar_index + 1
        )
      )
    )
  )
)
SELECT symbol, bar_index, CASE WHEN bar_index > 0 THEN round(sar, 6) END AS sar FROM s
"""
register("stop_and_reverse", lambda s, d: rounded(fold.fold(bars(s, d), lambda b: {"sar": fold.stop_and_reverse(b["high"], b["low"], b["close"])}, ["sar"]), "symbol", "bar_index", "sar"), SAR)


def planted_folds(spark, sf_dir: str) -> DataFrame:
    """Folds of which the first is tested on into the third."""
    f = backtest.folds(bars(spark, sf_dir), n_folds=4, embargo=5, min_test=10)
    far = F.max(F.when(F.col("fold") == 2, F.col("test_start") + 3)).over(Window.partitionBy(*audit.KEY))
    return f.withColumn("test_end", F.when(F.col("fold") == 0, far).otherwise(F.col("test_end")))


_PLANTED = """n AS (SELECT symbol, count(*) AS n, count(*) // 4 AS size FROM b GROUP BY symbol),
f0 AS (SELECT symbol, n, size, unnest(range(0, 4)) AS fold FROM n),
f1 AS (SELECT *, CAST(floor(size * 0.6::DOUBLE) AS BIGINT) AS tr FROM f0),
f2 AS (SELECT symbol, n, fold, fold * size AS train_start, CASE WHEN size - tr - 5 < 10 THEN size - 15 ELSE tr END AS train, CASE WHEN size - tr - 5 < 10 THEN 10 ELSE size - tr - 5 END AS test FROM f1),
f3 AS (SELECT symbol, fold, train_start, train_start + train AS train_end, train_start + train + 5 AS test_start, least(train_start + train + 5 + test, n) AS test_end FROM f2),
f AS (SELECT * REPLACE (CASE WHEN fold = 0 THEN max(CASE WHEN fold = 2 THEN test_start + 3 END) OVER (PARTITION BY symbol) ELSE test_end END AS test_end) FROM f3 WHERE test_start < test_end)"""
register("a42_overlaps", lambda s, d: audit.overlaps(planted_folds(s, d)).drop("interval"),
         f"WITH {BARS}, {_PLANTED} SELECT x.symbol, x.fold, y.fold AS other, least(x.test_end, y.test_end) - greatest(x.test_start, y.test_start) AS bars FROM f x JOIN f y ON x.symbol = y.symbol AND x.fold < y.fold AND x.test_start < y.test_end AND y.test_start < x.test_end")
register("a42_fold_usage", lambda s, d: audit.fold_usage(bars(s, d), planted_folds(s, d)).select("symbol", "fold", "train_bars", "test_bars", "embargo_bars", "train_from", "train_to", "test_from", "test_to"),
         f"""WITH {BARS}, {_PLANTED} SELECT f.symbol, fold, train_end - train_start AS train_bars, test_end - test_start AS test_bars, test_start - train_end AS embargo_bars,
b1."timestamp" AS train_from, b2."timestamp" AS train_to, b3."timestamp" AS test_from, b4."timestamp" AS test_to FROM f
LEFT JOIN b b1 ON b1.symbol = f.symbol AND b1.bar_index = train_start LEFT JOIN b b2 ON b2.symbol = f.symbol AND b2.bar_index = train_end - 1
LEFT JOIN b b3 ON b3.symbol = f.symbol AND b3.bar_index = test_start LEFT JOIN b b4 ON b4.symbol = f.symbol AND b4.bar_index = test_end - 1""")  # fmt: skip
_ISSUES = {
    "test parts overlap": "overlap_pairs > 0",
    "the embargo is under two horizons": "embargo < 48",
    "the embargo is very short": "embargo < 24",
    "many bars are unused": "unused_bars / bars > 0.1::DOUBLE",
    "the test parts are small": "test_bars / bars < 0.05::DOUBLE",
    "little is trained on": "train_bars / bars < 0.4::DOUBLE",
}
register("a42_audit", lambda s, d: audit.audit(bars(s, d), planted_folds(s, d)).drop("interval", "embargo").withColumn("issues", F.concat_ws("; ", "issues")),
         f"""WITH {BARS}, {_PLANTED}, t AS (SELECT symbol, count(*) AS bars, min("timestamp") AS first, max("timestamp") AS last FROM b GROUP BY symbol),
u AS (SELECT symbol, count(*) AS folds, CAST(sum(train_end - train_start) AS BIGINT) AS train_bars, CAST(sum(test_end - test_start) AS BIGINT) AS test_bars, CAST(sum(test_start - train_end) AS BIGINT) AS embargo_bars, min(test_start - train_end) AS embargo FROM f GROUP BY symbol),
o AS (SELECT x.symbol, count(*) AS overlap_pairs FROM f x JOIN f y ON x.symbol = y.symbol AND x.fold < y.fold AND x.test_start < y.test_end AND y.test_start < x.test_end GROUP BY x.symbol),
r AS (SELECT t.*, folds, train_bars, test_bars, embargo_bars, embargo, coalesce(overlap_pairs, 0) AS overlap_pairs, greatest(bars - train_bars - test_bars - embargo_bars, 0) AS unused_bars FROM t JOIN u USING (symbol) LEFT JOIN o USING (symbol))
SELECT * EXCLUDE (embargo), concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{text}' END" for text, c in _ISSUES.items())}) AS issues FROM r""")  # fmt: skip
_REGIME = f"""v0 AS (SELECT *, coalesce((close - lag(close) OVER {LAG}) / lag(close) OVER {LAG}, 0) AS ret FROM g),
v1 AS (SELECT *, CASE WHEN bar_index >= 20 THEN stddev_pop(ret) OVER ({O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) * sqrt(8760.0::DOUBLE) END AS vol FROM v0),
cuts AS (SELECT symbol, quantile_cont(vol, 0.33::DOUBLE) AS p33, quantile_cont(vol, 0.67::DOUBLE) AS p67 FROM v1 GROUP BY symbol),
reg AS (SELECT v1.symbol, bar_index, CASE WHEN vol <= p33 THEN 'low' WHEN vol <= p67 THEN 'medium' WHEN vol IS NOT NULL THEN 'high' END AS regime FROM v1 JOIN cuts USING (symbol))"""
register("a23_j08_trade_regimes", lambda s, d: rounded(audit.trade_regimes(backtest.trades(example(s, d), 6), example(s, d)), "symbol", "regime", "n_trades", "win_rate", "avg_return", "total_return", "sharpe", digits=4),
         f"""WITH {BARS}, {BASE}, {TRADE_SQL}, {_REGIME}
SELECT t.symbol, regime, count(*) AS n_trades, round(count_if(return_pct > 0)::DOUBLE / count(*), 4) AS win_rate, round(avg(return_pct), 4) AS avg_return, round(sum(return_pct), 4) AS total_return,
round(CASE WHEN stddev_pop(return_pct) > 0 THEN avg(return_pct) / stddev_pop(return_pct) ELSE 0 END, 4) AS sharpe
FROM trades t JOIN reg ON reg.symbol = t.symbol AND reg.bar_index = t.entry_bar WHERE regime IS NOT NULL AND t.symbol IN (SELECT symbol FROM trades GROUP BY symbol HAVING count(*) >= 20) GROUP BY ALL HAVING count(*) >= 5""")  # fmt: skip


def scored(spark, sf_dir: str) -> DataFrame:
    rows_ = audit.with_regime(example(spark, sf_dir)).withColumn("forward_return", series.forward_return(F.col("close"), 3))
    found = audit.regime_scores(backtest.labels(rows_, F.round("combined_signal", 9)), ["symbol"])
    return rounded(found, "symbol", "regime", "n", "mcc", "accuracy", "mean_return", "sharpe", digits=4)


register("a25_regime_scores", scored,
         f"""WITH {BARS}, {BASE}, {_REGIME}, l AS (SELECT g.symbol, g.bar_index, round(score0, 9) AS score, (lead(close, 3) OVER {LAG} - close) / close * 100 AS fr FROM g),
k AS (SELECT l.*, regime, sign(score) * fr AS taken FROM l JOIN reg USING (symbol, bar_index) WHERE fr IS NOT NULL AND fr <> 0 AND score IS NOT NULL AND regime IS NOT NULL),
c AS (SELECT symbol, regime, count(*) AS n, count_if(fr > 0 AND score >= 0) AS tp, count_if(fr < 0 AND score >= 0) AS fp, count_if(fr < 0 AND score < 0) AS tn, count_if(fr > 0 AND score < 0) AS fn,
avg(taken) AS m, stddev_pop(taken) AS sd FROM k GROUP BY ALL)
SELECT symbol, regime, n, round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 4) AS mcc,
round((tp + tn)::DOUBLE / n, 4) AS accuracy, round(m, 4) AS mean_return, round(CASE WHEN sd > 0 THEN m / sd ELSE 0 END, 4) AS sharpe FROM c""")  # fmt: skip


def full_report(spark, sf_dir: str) -> DataFrame:
    """The quality report of each symbol's roll-up, flattened."""
    rolled = backtest.roll_up(fold_rows(spark, sf_dir), ["symbol"])
    mcc, auc = F.round("mcc", 9), F.round("roc_auc", 9)
    made = rolled.select("symbol", stats.quality_report(mcc, auc, F.col("samples"), F.col("consistency"), F.col("profit_factor")).alias("q")).select("symbol", "q.*")
    return rounded(made.withColumn("advice", F.concat_ws("; ", "advice")), *made.columns, digits=4)


_Z, _ZZ = "1.959963984540054::DOUBLE", "2.8015852181129683::DOUBLE"
register("a39_full_report", full_report,
         ROLL + f""", q0 AS (SELECT * REPLACE (round(mcc, 9) AS mcc, round(roc_auc, 9) AS roc_auc), tanh({_ZZ} / sqrt(greatest(samples - 3, 1))) AS detectable FROM rr),
q1 AS (SELECT *, CASE WHEN abs(mcc) >= 0.999 THEN mcc - 0.01 * {_Z} ELSE tanh(atanh(mcc) - {_Z} / sqrt(samples - 3)) END AS ci_low, CASE WHEN abs(mcc) >= 0.999 THEN mcc + 0.01 * {_Z} ELSE tanh(atanh(mcc) + {_Z} / sqrt(samples - 3)) END AS ci_high FROM q0),
q2 AS (SELECT *, concat_ws('; ', CASE WHEN samples < 100 THEN 'too few samples' WHEN samples < 500 THEN 'samples are marginal' END, CASE WHEN mcc < detectable THEN 'the effect is below what the samples can detect' END,
 CASE WHEN ci_high - ci_low > 0.3 THEN 'the interval is wide' END, CASE WHEN consistency < 0.5 THEN 'folds disagree' END) AS said FROM q1)
SELECT symbol, samples, round(detectable, 4) AS detectable, samples >= 100 AND mcc >= detectable AS adequate, round(mcc, 4) AS mcc, round(roc_auc, 4) AS roc_auc, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high,
round(ci_high - ci_low, 4) AS ci_width, ci_low > 0 AS significant, CASE WHEN mcc >= 0.5 THEN 'large' WHEN mcc >= 0.3 THEN 'medium' WHEN mcc >= 0.1 THEN 'small' ELSE 'trivial' END AS effect,
round(consistency, 4) AS consistency, round(profit_factor, 4) AS profit_factor, consistency >= 0.5 AS steady, CASE WHEN said = '' THEN 'adequate for inference' ELSE said END AS advice FROM q2""")  # fmt: skip


def effective(spark, sf_dir: str) -> DataFrame:
    """The three sizes left after autocorrelation, of the returns of each symbol."""
    back = F.lag("close").over(series.by_series())
    moved = bars(spark, sf_dir).withColumn("r", F.try_divide(F.col("close") - back, back)).where("r IS NOT NULL")
    x = stats.lag_correlations(moved, "r", ["symbol"], "bar_index", 1)
    n, rho = F.col("n"), F.round("rho1", 9)
    return rounded(x.withColumns({"evaluated": stats.effective_size(n, rho), "loose": stats.effective_size(n, rho, 1.0), "whole": stats.effective_whole(n, rho)}), "symbol", "n", "evaluated", "loose", "whole", digits=4)


register("a22_effective_sizes", effective,
         f"""WITH {BARS}, r0 AS (SELECT symbol, bar_index, (close - lag(close) OVER {LAG}) / lag(close) OVER {LAG} AS r FROM b), r1 AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol) AS d FROM r0 WHERE r IS NOT NULL),
r2 AS (SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY bar_index) AS d1 FROM r1), r3 AS (SELECT symbol, count(*) AS n, round(sum(d * d1) / (count(*) * var_pop(r)), 9) AS rho FROM r2 GROUP BY symbol)
SELECT symbol, n, round(greatest(3, n * (1 - rho) / (1 + rho)), 4) AS evaluated, round(greatest(1, n * (1 - rho) / (1 + rho)), 4) AS loose, CAST(greatest(1, floor(n * (1 - rho) / (1 + rho))) AS BIGINT) AS whole FROM r3""")  # fmt: skip
