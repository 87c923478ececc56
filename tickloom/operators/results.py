"""Tables of results: pairing, ranking, trimming, merging and describing them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import scalar


def finite(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value is a finite number."""
    x = F.col(column)
    return rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def same_context(rows: DataFrame, symbol: str, interval: str) -> DataFrame:
    """Results of one symbol (or of ALL) and interval."""
    return rows.where(F.col("symbol").isin(symbol, "ALL") & (F.col("interval") == interval))


def in_band(rows: DataFrame, keys: list[str], order: str, metric: str, low: float, high: float) -> DataFrame:
    """Rows of the keys whose latest known metric lies within low and high."""
    latest = rows.where(F.col(metric).isNotNull()).groupBy(*keys).agg(F.max_by(metric, order).alias("__latest")).where(F.col("__latest").between(low, high))
    return rows.join(latest.drop("__latest"), keys, "left_semi")


def pick(rows: DataFrame, column: str, numbers: list[int], fragments: list[str]) -> DataFrame:
    """Rows chosen by their number in name order (from 1) or by a fragment of the name, each once."""
    chosen = F.row_number().over(Window.orderBy(column)).isin(numbers or [0])
    for text in fragments:
        chosen = chosen | F.lower(column).contains(text.lower())
    return rows.withColumn("__c", chosen).where("__c").drop("__c")


def paired(original: DataFrame, optimised: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, before, after, change_pct, improved), a row a metric; what either side lacks
    is missing."""
    one, two = (df.select(*keys, F.struct(*[F.col(m).cast("double").alias(m) for m in metrics]).alias(name)) for df, name in ((original, "o"), (optimised, "n")))
    both = one.join(two, keys, "full")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"o.{m}").alias("before"), F.col(f"n.{m}").alias("after")) for m in metrics])
    change = F.try_divide((F.col("after") - F.col("before")) * 100, F.abs("before"))
    return both.select(*keys, F.inline(each)).withColumn("change_pct", change).withColumn("improved", F.coalesce(F.col("after") > F.col("before"), F.lit(False)))


def rankings(pairs: DataFrame, keys: list[str], over: list[str] | None = None) -> DataFrame:
    """Pairs with `rank` within each metric by the value after, best first (ties by the keys)."""
    w = Window.partitionBy("metric", *(over or [])).orderBy(F.desc_nulls_last("after"), *keys)
    return pairs.withColumn("rank", F.row_number().over(w))


def ends(rows: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """The n best and the n worst rows, with `end` best or worst."""
    best = rows.orderBy(F.desc(column), *ties).limit(n).withColumn("end", F.lit("best"))
    return best.unionAll(rows.orderBy(F.asc(column), *ties).limit(n).withColumn("end", F.lit("worst")))


def trimmed(rows: DataFrame, keys: list[str], order: str, first: int = 10, last: int = 190) -> DataFrame:
    """The first and the last rows of each history; a short history whole."""
    up = Window.partitionBy(*keys).orderBy(order)
    n, size = F.row_number().over(up), F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({"__n": n, "__z": size}).where((F.col("__n") <= first) | (F.col("__n") > F.col("__z") - last)).drop("__n", "__z")


def merged(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union by name; of rows with equal keys that of the latest table stays."""
    numbered = [t.withColumn("__t", F.lit(k)) for k, t in enumerate(tables)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return every.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__t")))).where("__r = 1").drop("__t", "__r")


def over_baseline(rows: DataFrame, baseline: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """rows with the baseline of their key, and the gain over it (missing without one)."""
    known = baseline.select(*keys, F.col(metric).alias("baseline")).dropDuplicates(keys)
    return rows.join(known, keys, "left").withColumn("gain", F.col(metric) - F.col("baseline"))


def summary(rows: DataFrame, keys: list[str], objective: str, seconds: str) -> DataFrame:
    x, t = F.col(objective), F.col(seconds)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.max(x).alias("best"), F.min(x).alias("worst"), F.avg(t).alias("mean_seconds"), F.sum(t).alias("total_seconds"))


def by_folder(paths: DataFrame, column: str, ending: str = ".pine") -> DataFrame:
    """(folder, n): files of an ending in each folder."""
    return paths.where(F.col(column).endswith(ending)).groupBy(F.regexp_extract(column, "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n"))


def time_budgets(scripts: DataFrame, seconds: float, least: float = 60.0) -> DataFrame:
    """Scripts with an equal share of the time, `least` seconds at least."""
    return scripts.withColumn("seconds", F.lit(max(seconds / max(scripts.count(), 1), float(least))))


def canonical(params: Column) -> Column:
    """A map of parameters as JSON text with its keys in order: equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def parameter(params: Column, name: str) -> Column:
    """The value of a name in a map: of that name, else of the first that is equal but for case,
    else of the first that is equal, contains it, or is contained in it, letters and digits alone."""

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")

    keys, want = F.map_keys(params), bare(F.lit(name))
    same_letters = F.filter(keys, lambda k: F.lower(k) == name.lower())
    alike = F.filter(keys, lambda k: (bare(k) != "") & (F.contains(bare(k), want) | F.contains(want, bare(k))))
    found = F.coalesce(F.when(F.array_contains(keys, name), F.lit(name)), F.try_element_at(same_letters, F.lit(1)), F.try_element_at(alike, F.lit(1)))
    return F.try_element_at(params, found)


def quality_report(mcc: Column, n: Column, effective: Column, consistency: Column) -> Column:
    """Effect, sample and reliability of a result, with what to do about them."""
    advice = F.array_compact(
        F.array(
            F.when(n < 100, F.lit("collect more samples")), F.when(effective < 0.5 * n, F.lit("returns are correlated: widen the embargo")),
            F.when(F.abs(mcc) < 0.1, F.lit("the effect is negligible")), F.when(consistency < 0.5, F.lit("folds disagree")),
        )
    )
    return F.struct(scalar.mcc_label(mcc).alias("effect"), (F.coalesce(effective / n, F.lit(0.0))).alias("independence"), (n >= 100).alias("enough"), advice.alias("advice"))


def market_text(win_rate: Column, profit_factor: Column, horizon_hours: Column) -> Column:
    """Words for when a result works: how often, how well, and how long."""
    often = F.when(win_rate >= 0.6, "high hit rate").when(win_rate >= 0.5, "balanced hit rate").otherwise("few large wins")
    well = F.when(profit_factor >= 2, "strong edge").when(profit_factor >= 1, "thin edge").otherwise("no edge")
    return F.concat_ws(", ", often, well, F.concat(F.lit("held "), scalar.duration_text(horizon_hours)))
