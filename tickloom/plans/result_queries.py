"""Queries of result tables, scalars and source helpers, over walk-forward results of the bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalar
from tickloom.operators import ensemble, results, subsets
from tickloom.plans import sql
from tickloom.plans.evaluation_queries import fold_rows, fold_sql, shown
from tickloom.plans.registry import register
from tickloom.plans.series_queries import bars
from tickloom.plans.sql import BARS, LAG, rows
from tickloom.sources import bars as source
from tickloom.sources import results as stored_results

KEYS, METRICS = ["symbol", "fold"], ["mcc", "profit_factor", "accuracy"]


def fold_pairs(spark, sf_dir: str) -> DataFrame:
    """Results that trade on discrete signals against those that trade on the combined signal."""
    return results.paired(fold_rows(spark, sf_dir, True), fold_rows(spark, sf_dir, False), KEYS, METRICS)


PAIRED = f"""WITH o AS ({fold_sql(True)} SELECT * FROM fm), n AS ({fold_sql(False)} SELECT * FROM fm), p AS (
""" + " UNION ALL ".join(f"SELECT symbol, fold, '{m}' AS metric, CAST(o.{m} AS DOUBLE) AS before, CAST(n.{m} AS DOUBLE) AS after FROM o FULL JOIN n USING (symbol, fold)" for m in METRICS) + """),
q AS (SELECT *, CASE WHEN before <> 0 THEN (after - before) * 100 / abs(before) END AS change_pct, coalesce(after > before, false) AS improved FROM p)"""
register("j09_o15_paired", lambda s, d: shown(fold_pairs(s, d), *KEYS, "metric", "before", "after", "change_pct", "improved", digits=3),
         PAIRED + " SELECT symbol, fold, metric, round(before, 3) AS before, round(after, 3) AS after, round(change_pct, 3) AS change_pct, improved FROM q")
register("t04_rankings", lambda s, d: shown(results.rankings(fold_pairs(s, d).withColumn("after", F.round("after", 6)), KEYS), *KEYS, "metric", "after", "rank", digits=3),
         PAIRED + " SELECT symbol, fold, metric, round(after, 3) AS after, CAST(row_number() OVER (PARTITION BY metric ORDER BY round(after, 6) DESC NULLS LAST, symbol, fold) AS INT) AS rank FROM q")
register("t03_best_and_worst", lambda s, d: shown(results.ends(results.finite(fold_rows(s, d).withColumn("mcc", F.round("mcc", 6)), "mcc"), "mcc", 3, *KEYS), *KEYS, "mcc", "end", digits=4),
         fold_sql(True) + """, ok AS (SELECT symbol, fold, round(mcc, 6) AS mcc FROM fm) SELECT symbol, fold, round(mcc, 4) AS mcc, 'best' AS "end" FROM (SELECT * FROM ok ORDER BY mcc DESC, symbol, fold LIMIT 3)
UNION ALL SELECT symbol, fold, round(mcc, 4), 'worst' FROM (SELECT * FROM ok ORDER BY mcc, symbol, fold LIMIT 3)""")  # fmt: skip
register("t06_trimmed_history", lambda s, d: results.trimmed(bars(s, d), ["symbol"], "bar_index", 10, 50).select("symbol", "bar_index", F.round("close", 4).alias("close")),
         f"WITH {BARS}, n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS z FROM b) SELECT symbol, bar_index, round(close, 4) AS close FROM n WHERE bar_index < 10 OR bar_index >= z - 50")


def nations(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


register("u03_u04_merged", lambda s, d: results.merged([nations(s, d).where("n_nationkey < 15").select("n_name", F.col("n_regionkey").alias("score")), nations(s, d).where("n_nationkey >= 10").select("n_name", (F.col("n_regionkey") + 10).alias("score"), F.lit("new").alias("origin"))], ["n_name"]),
         "SELECT n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey + 10 ELSE n_regionkey END AS score, CASE WHEN n_nationkey >= 10 THEN 'new' END AS origin FROM nation")
register("p13_picked", lambda s, d: results.pick(nations(s, d), "n_name", [1, 3], ["united", "IND"]).select("n_name"),
         "SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS k FROM nation) WHERE k IN (1, 3) OR contains(lower(n_name), 'united') OR contains(lower(n_name), 'ind')")
register("a43_a45_summary", lambda s, d: shown(results.summary(fold_rows(s, d).withColumn("seconds", F.col("samples") / 10.0), ["horizon"], "mcc", "seconds"), "horizon", "n", "mean", "best", "worst", "mean_seconds", "total_seconds", digits=4),
         fold_sql(True) + " SELECT horizon, count(*) AS n, round(avg(mcc), 4) AS mean, round(max(mcc), 4) AS best, round(min(mcc), 4) AS worst, round(avg(samples / 10.0::DOUBLE), 4) AS mean_seconds, round(sum(samples / 10.0::DOUBLE), 4) AS total_seconds FROM fm GROUP BY horizon")
register("j10_over_baseline", lambda s, d: shown(results.over_baseline(fold_rows(s, d), fold_rows(s, d).where("fold = 0"), ["symbol"], "mcc"), *KEYS, "baseline", "gain", digits=4),
         fold_sql(True) + " SELECT fm.symbol, fm.fold, round(z.mcc, 4) AS baseline, round(fm.mcc - z.mcc, 4) AS gain FROM fm LEFT JOIN (SELECT * FROM fm WHERE fold = 0) z ON fm.symbol = z.symbol")
register("p12_in_band", lambda s, d: results.in_band(bars(s, d), ["symbol"], "bar_index", "close", 20.0, 80.0).groupBy("symbol").count().withColumnRenamed("count", "n"),
         f"WITH {BARS}, l AS (SELECT symbol, arg_max(close, bar_index) AS last, count(*) AS n FROM b GROUP BY symbol) SELECT symbol, n FROM l WHERE last BETWEEN 20 AND 80")
register("a39_quality_report", lambda s, d: shown(fold_rows(s, d).withColumn("q", results.quality_report(F.round("mcc", 6), F.col("samples"), F.col("samples") * 0.4, F.lit(0.6))).select(*KEYS, "q.effect", "q.independence", "q.enough", F.concat_ws("; ", "q.advice").alias("advice")), *KEYS, "effect", "independence", "enough", "advice"),
         fold_sql(True) + """ SELECT symbol, fold, CASE WHEN m >= 0.7 THEN 'very strong positive' WHEN m >= 0.5 THEN 'strong positive' WHEN m >= 0.3 THEN 'moderate positive' WHEN m >= 0.1 THEN 'weak positive' WHEN m > -0.1 THEN 'none' WHEN m > -0.3 THEN 'weak negative' ELSE 'negative' END AS effect,
0.4::DOUBLE AS independence, samples >= 100 AS enough, concat_ws('; ', CASE WHEN samples < 100 THEN 'collect more samples' END, 'returns are correlated: widen the embargo', CASE WHEN abs(m) < 0.1 THEN 'the effect is negligible' END) AS advice FROM (SELECT *, round(mcc, 6) AS m FROM fm)""")  # fmt: skip


def texts(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    interval = F.concat((F.col("event_id") % 12 + 1).cast("string"), F.element_at(F.array(*[F.lit(x) for x in "mhdwM"]), (F.col("event_id") % 5 + 1).cast("int")))
    label = F.concat(F.col("event_type"), F.lit(":S"), F.col("user_id").cast("string"), F.lit("@"), interval)
    name, symbol, at = scalar.label_parts(label)
    return e.select(
        "event_id", scalar.interval_seconds(interval).alias("seconds"), name, symbol, at, scalar.safe_tag(label).alias("tag"),
        scalar.report_number(F.concat(F.lit(" 1,"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("% "))).alias("number"),
        F.round(scalar.normal_cdf(F.col("value") / 100 - 1), 6).alias("cdf"), source.symbol_name(F.col("event_type")).alias("pair"),
    )


register("m19_m25_texts", texts, """WITH t AS (SELECT *, CAST(event_id % 12 + 1 AS VARCHAR) || substr('mhdwM', CAST(event_id % 5 + 1 AS INT), 1) AS iv FROM events)
SELECT event_id, (event_id % 12 + 1) * CASE event_id % 5 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 604800 ELSE 2592000 END AS seconds, event_type AS indicator, 'S' || CAST(user_id AS VARCHAR) AS symbol, iv AS "interval",
event_type || '_S' || CAST(user_id AS VARCHAR) || '_' || iv AS tag, (1000 + event_id % 1000)::DOUBLE AS number, round(0.5 * (1 + tanh(0.79788::DOUBLE * (value / 100 - 1))), 6) AS cdf, upper(event_type) || 'USDT' AS pair FROM t""")


def members(spark, sf_dir: str) -> DataFrame:
    return ensemble.members(bars(spark, sf_dir)).select("symbol", "bar_index", "member", "buy", "sell")


def _cross(a: str, b: str) -> tuple[str, str]:
    return f"lag({a}) OVER {LAG} <= lag({b}) OVER {LAG} AND {a} > {b}", f"lag({a}) OVER {LAG} >= lag({b}) OVER {LAG} AND {a} < {b}"


_S = sql.sma
_STEPS = f"""m1 AS (SELECT *, close - lag(close, 14) OVER {LAG} AS mom, CASE WHEN lag(close, 14) OVER {LAG} = 0 THEN 0 ELSE 100 * (close - lag(close, 14) OVER {LAG}) / lag(close, 14) OVER {LAG} END AS roc,
 coalesce(sum(sign(close - prev) * volume) OVER (PARTITION BY symbol ORDER BY bar_index), 0) AS obv, sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol ORDER BY bar_index) / sum(volume) OVER (PARTITION BY symbol ORDER BY bar_index) AS vwap,
 (max(high) OVER {rows(9)} + min(low) OVER {rows(9)}) / 2 AS tenkan, (max(high) OVER {rows(26)} + min(low) OVER {rows(26)}) / 2 AS kijun, (lag(high) OVER {LAG} + lag(low) OVER {LAG} + prev) / 3 AS pv,
 {_S('(high + low) / 2', 5)} - ({_S('(high + low) / 2', 34)}) AS ao, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume AS flow FROM (SELECT *, lag(close) OVER {LAG} AS prev FROM b)),
m2 AS (SELECT *, {_S('obv', 14)} AS obv_mean, ao - ({_S('ao', 5)}) AS ac, ({_S('flow', 14)}) / ({_S('volume', 14)}) AS cmf, {_S('roc', 5)} AS roc_mean,
 max(high) OVER {rows(14)} AS hh, min(low) OVER {rows(14)} AS ll, (high + low + close) / 3 AS tp, {_S('close', 20)} AS mid, {sql.stdev('close', 20)} AS wide, {_S('close', 14)} AS short, {_S('close', 28)} AS long FROM m1),
m3 AS (SELECT *, CASE WHEN hh = ll THEN 50 ELSE 100 * (close - ll) / (hh - ll) END AS k, CASE WHEN hh > ll THEN -100 * (hh - close) / (hh - ll) END AS w, list(tp) OVER {rows(20)} AS tps, {_S('tp', 20)} AS tm,
 tp - coalesce(lag(tp) OVER {LAG}, tp) AS td, tp * volume AS tf FROM m2),
m4 AS (SELECT *, {_S('k', 3)} AS d, list_avg(list_transform(tps, lambda x: abs(x - tm))) AS dev, sum(CASE WHEN td > 0 THEN tf ELSE 0 END) OVER {rows(14)} AS gained, sum(CASE WHEN td < 0 THEN tf ELSE 0 END) OVER {rows(14)} AS lost, count(tf) OVER {rows(14)} AS flows FROM m3),
m5 AS (SELECT *, CASE WHEN tm IS NOT NULL THEN CASE WHEN dev = 0 THEN 0 ELSE (tp - tm) / (0.015 * dev) END END AS cci, CASE WHEN flows = 14 THEN 100 - 100 / (1 + CASE WHEN lost = 0 THEN 100 ELSE gained / lost END) END AS mfi FROM m4)"""
_RULES = {
    "momentum": (f"mom > 0 AND mom > lag(mom) OVER {LAG}", f"mom < 0 AND mom < lag(mom) OVER {LAG}"), "obv": ("obv > obv_mean", "obv < obv_mean"), "vwap": _cross("close", "vwap"),
    "ichimoku": _cross("tenkan", "kijun"), "pivot": _cross("close", "pv"),
    "accelerator": (f"ac > 0 AND ac > lag(ac) OVER {LAG}", f"ac < 0 AND ac < lag(ac) OVER {LAG}"), "chaikin": ("cmf > 0.05", "cmf < -0.05"),
    "generic": (f"roc > 0 AND {_cross('roc', 'roc_mean')[0]}", f"roc < 0 AND {_cross('roc', 'roc_mean')[1]}"),
    "stoch": (f"k < 20 AND {_cross('k', 'd')[0]}", f"k > 80 AND {_cross('k', 'd')[1]}"), "cci": ("cci < -100", "cci > 100"), "mfi": ("mfi < 20", "mfi > 80"),
    "bollinger": ("close < mid - 2 * wide", "close > mid + 2 * wide"), "williams": ("w < -80", "w > -20"), "sma_cross": _cross("short", "long"),
}
register("e01_members", lambda s, d: members(s, d).where(F.col("member").isin(list(_RULES))),
         f"WITH {BARS}, {_STEPS} " + " UNION ALL ".join(f"SELECT symbol, bar_index, '{n}' AS member, coalesce({x}, false) AS buy, coalesce({y}, false) AS sell FROM m5" for n, (x, y) in _RULES.items()))


_EVERY = " UNION ALL ".join(f"SELECT symbol, bar_index, coalesce({x}, false)::INT AS buy, coalesce({y}, false)::INT AS sell FROM m5" for x, y in _RULES.values())
for rule, held in (("majority", "{x} > 0.5"), ("weighted", "{x} >= 0.375"), ("unanimous", "{x} >= 1")):
    register("ensemble_votes" if rule == "majority" else f"ensemble_votes_{rule}",
             lambda s, d, rule=rule: shown(ensemble.votes(ensemble.members(bars(s, d)).where(F.col("member").isin(list(_RULES))), rule, 0.375), "symbol", "bar_index", "buy_ratio", "sell_ratio", "strength", "buy_signal", "sell_signal"),
             f"WITH {BARS}, {_STEPS}, e AS ({_EVERY}), v AS (SELECT symbol, bar_index, avg(buy) AS up, avg(sell) AS down FROM e GROUP BY ALL) SELECT symbol, bar_index, round(up, 6) AS buy_ratio, round(down, 6) AS sell_ratio, round(up - down, 6) AS strength, {held.format(x='up')} AS buy_signal, {held.format(x='down')} AS sell_signal FROM v")
register("e01_recursive_members", lambda s, d: ensemble.recursive_members(bars(s, d)).select("symbol", "bar_index", "member", "buy", "sell"))



#: The members of which every subset is tried.
_FEW = list(_RULES)[:8]


def subset_scores(spark, sf_dir: str) -> DataFrame:
    """Every subset of two of the eight members or more, scored over all bars by one job."""
    b = bars(spark, sf_dir)
    found = subsets.patterns(subsets.member_bits(ensemble.members(b), _FEW), b, 3)
    rows_ = subsets.scored(found, subsets.every_subset(spark, len(_FEW)), n=len(_FEW))
    return shown(rows_, "symbol", "trial_id", "tp", "fp", "tn", "fn", "signals", "total_return", "mcc", digits=4)


_BITS = " + ".join("(coalesce({%d}, false)::BIGINT << %d)" % (k, k) for k in range(len(_FEW)))
_HELD = "bit_count({} & id) / bit_count(id) > 0.5::DOUBLE"
register("o14_subset_scores", subset_scores,
         f"""WITH {BARS}, {_STEPS}, v AS (SELECT symbol, bar_index, {_BITS.format(*[_RULES[n][0] for n in _FEW])} AS bb, {_BITS.format(*[_RULES[n][1] for n in _FEW])} AS sb FROM m5),
m AS (SELECT symbol, bar_index, (lead(close, 3) OVER {LAG} - close) / close * 100 AS fr FROM b), x AS (SELECT symbol, bb, sb, fr FROM v JOIN m USING (symbol, bar_index) WHERE fr IS NOT NULL),
d AS (SELECT symbol, id, fr, {_HELD.format('bb')} AS up, {_HELD.format('sb')} AS down FROM x, range(1, 256) s(id) WHERE bit_count(id) >= 2),
k AS (SELECT symbol, id AS trial_id, count_if(up AND NOT down AND fr > 0) AS tp, count_if(up AND NOT down AND fr < 0) AS fp, count_if(down AND NOT up AND fr < 0) AS tn, count_if(down AND NOT up AND fr > 0) AS fn,
sum(CASE WHEN up AND NOT down THEN fr WHEN down AND NOT up THEN -fr ELSE 0 END) AS gain FROM d GROUP BY ALL)
SELECT symbol, trial_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(tp + fp + tn + fn AS BIGINT) AS signals, round(gain, 4) AS total_return,
round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 4) AS mcc FROM k""")  # fmt: skip


ROW = "file_name string, symbol string, interval string, mcc double"


def stored(spark, sf_dir: str) -> DataFrame:
    """Scores of suppliers written as JSON documents, one a symbol, and read from them."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows = s.select(F.when(F.col("s_suppkey") % 7 != 0, F.concat("s_name", F.lit(".pine"))).alias("file_name"), (F.col("s_nationkey") % 3).cast("string").alias("symbol"), F.lit("1d").alias("interval"), F.round(F.col("s_acctbal") / 10000, 6).alias("mcc"))
    return stored_results.matrix(stored_results.documents(rows, ["symbol"], F.lit("a")), "value", ROW)


def reports(spark, sf_dir: str) -> DataFrame:
    """A text report for each nation."""
    k = F.col("n_nationkey")
    body = F.concat(
        F.lit("ML OPTIMIZATION REPORT: "), F.col("n_name"), F.lit("\n\nOptimization config:\n  Strategy: tpe\n  Max trials: "), (k + 10).cast("string"), F.lit("\n\nNot: a setting\nPERFORMANCE COMPARISON\n----------\nMetric        Original    Optimized   Change\nTotal Trades  1,"),
        F.lpad(k.cast("string"), 3, "0"), F.lit("       N/A         -\nWin Rate      50.0%       "), (k + 40).cast("string"), F.lit("%         +1\n\nOverall Performance\nMCC  1  2  3\n"),
    )
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("report"), body.alias("body"))


register("s16_s18_stored_results", stored,
         """SELECT 'a' AS run, s_name || '.pine' AS file_name, CAST(s_nationkey % 3 AS VARCHAR) AS symbol, '1d' AS "interval", round(s_acctbal / 10000, 6) AS mcc FROM supplier WHERE s_suppkey % 7 <> 0""")  # fmt: skip
register("s19_report_comparison", lambda s, d: shown(stored_results.comparison(reports(s, d), "body", ["report"]), "report", "metric", "before", "after", digits=6),
         """SELECT n_name AS report, 'total_trades' AS metric, 1000.0::DOUBLE + n_nationkey AS before, NULL::DOUBLE AS after FROM nation
UNION ALL SELECT n_name, 'win_rate', 0.5::DOUBLE, round((n_nationkey + 40) / 100.0::DOUBLE, 6) FROM nation""")  # fmt: skip
register("s19_report_settings", lambda s, d: stored_results.settings(reports(s, d), "body", ["report"]),
         "SELECT n_name AS report, 'Strategy' AS name, 'tpe' AS value FROM nation UNION ALL SELECT n_name, 'Max trials', CAST(n_nationkey + 10 AS VARCHAR) FROM nation")


def flat_rows(spark, sf_dir: str) -> DataFrame:
    """A flat row for each nation; every fifth has no measures."""
    key = F.col("n_nationkey")
    measures = F.create_map(F.lit("mcc"), key / 25.0, F.lit("roc_auc"), 0.5 + key / 100.0, F.lit("total_trades"), key.cast("double"))
    rows_ = nations(spark, sf_dir).select(
        F.col("n_name").alias("indicator_name"), F.concat("n_name", F.lit(".pine")).alias("file_name"), F.lit("X").alias("symbol"), F.lit("1d").alias("interval"), (key % 2 == 0).alias("improved"),
        (key / 10.0).alias("objective_best"), F.when(key % 5 > 0, measures).alias("best_metrics"), F.create_map(F.lit("slow"), key + 20.0, F.lit("fast"), key + 2.5).alias("best_params"), key.alias("n_trials"),
    )
    return stored_results.flat_matrix(rows_)


_KNOWN = {
    "indicator_name": "n_name", "file_name": "n_name || '.pine'", "symbol": "'X'", "interval": "'1d'", "improved": "n_nationkey % 2 = 0", "objective_best": "n_nationkey / 10.0::DOUBLE",
    "mcc": "CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey / 25.0::DOUBLE END", "roc_auc": "CASE WHEN n_nationkey % 5 > 0 THEN 0.5::DOUBLE + n_nationkey / 100.0::DOUBLE END",
    "total_trades": "CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey::DOUBLE END", "n_trials": "n_nationkey",
    "best_params": "'{\"fast\":' || printf('%.1f', n_nationkey + 2.5) || ',\"slow\":' || printf('%.1f', n_nationkey + 20.0) || '}'",
}
register("s17_flat_matrix", flat_rows, "SELECT " + ", ".join(f"{_KNOWN.get(n, 'NULL::DOUBLE')} AS \"{n}\"" for n in stored_results.MATRIX) + " FROM nation")
