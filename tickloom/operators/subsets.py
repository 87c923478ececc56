"""Search over an ensemble's members: the votes of many subsets and weights at once.

The members' votes of a bar are bits of two numbers. Bars that agree in them are summed up once, so
what meets the trials are the distinct patterns, not the bars; one job scores every trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import backtest

KEY = ["symbol", "interval"]
#: Most members that a number's bits hold, and most of which every subset is tried.
MOST_MEMBERS, MOST_LISTED = 62, 20
RULES = ("majority", "unanimous", "weighted")


def member_bits(signals: DataFrame, members: list[str]) -> DataFrame:
    """(symbol, interval, timestamp, bar_index, buy_bits, sell_bits): bit k is the vote of members[k];
    other members do not count."""
    if len(members) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    bit = F.coalesce(*[F.when(F.col("member") == name, F.lit(1 << k).cast("long")) for k, name in enumerate(members)])
    sums = [F.coalesce(F.bit_or(F.when(F.col(c), bit)), F.lit(0).cast("long")).alias(f"{c}_bits") for c in ("buy", "sell")]
    return signals.where(F.col("member").isin(members)).groupBy(*KEY, "timestamp", "bar_index").agg(*sums)


def patterns(bits: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """(symbol, interval, buy_bits, sell_bits, ups, downs, gain): bars by their votes, with how many
    rose and fell within the horizon, and the sum of their returns in percent."""
    r = F.col("forward_return")
    moved = bars.select(*KEY, "timestamp", series.forward_return(F.col("close"), horizon).alias("forward_return")).where(r.isNotNull())
    return bits.join(moved, [*KEY, "timestamp"]).groupBy(*KEY, "buy_bits", "sell_bits").agg(F.count_if(r > 0).alias("ups"), F.count_if(r < 0).alias("downs"), F.sum(r).alias("gain"))


def every_subset(spark: SparkSession, n: int, least: int = 2) -> DataFrame:
    """(trial_id, subset) of every subset of n members with `least` of them at least."""
    if n > MOST_LISTED:
        raise ValueError(f"every subset only of {MOST_LISTED} members")
    return spark.range(1, 1 << n).where(F.bit_count("id") >= least).select(F.col("id").alias("trial_id"), F.col("id").alias("subset"))


def _ratio(bits: Column, subset: Column, weights: Column | None, n: int) -> Column:
    if weights is None:
        return F.bit_count(bits.bitwiseAND(subset)) / F.bit_count(subset)

    def total(mask: Column) -> Column:
        return sum((F.when(F.getbit(mask, F.lit(k)) == 1, weights[k]).otherwise(0.0) for k in range(n)), F.lit(0.0))

    return F.try_divide(total(bits.bitwiseAND(subset)), total(subset))


def scored(found: DataFrame, trials: DataFrame, rule: str = "majority", threshold: float = 0.5, n: int = MOST_MEMBERS, by: list[str] | None = None) -> DataFrame:
    """(by, trial_id, tp, fp, tn, fn, signals, total_return, mcc) of each trial over the patterns: a bar
    is bought where the rule holds for the buys alone, sold where for the sells alone. trials:
    (trial_id, subset), and `weights`, an array of one number a member, if votes are weighed."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    by = KEY if by is None else by
    weights = F.col("weights") if "weights" in trials.columns else None
    rows = found.crossJoin(trials)

    def held(c: str) -> Column:
        x = _ratio(F.col(c), F.col("subset"), weights, n)
        return F.coalesce({"unanimous": x >= 1, "weighted": x >= threshold, "majority": x > 0.5}[rule], F.lit(False))

    rows = rows.withColumns({"__b": held("buy_bits"), "__s": held("sell_bits")})
    long, short = F.col("__b") & ~F.col("__s"), F.col("__s") & ~F.col("__b")
    sums = {"tp": (long, "ups"), "fp": (long, "downs"), "tn": (short, "downs"), "fn": (short, "ups")}
    out = rows.groupBy(*by, "trial_id").agg(
        *[F.sum(F.when(c, F.col(x)).otherwise(0)).alias(k) for k, (c, x) in sums.items()],
        F.sum(F.when(long, F.col("gain")).when(short, -F.col("gain")).otherwise(0.0)).alias("total_return"),
    )
    tp, fp, tn, fn = (F.col(k) for k in sums)
    return out.withColumns({"signals": tp + fp + tn + fn, "mcc": backtest.mcc(tp, fp, tn, fn)})


def best_subsets(scores: DataFrame, by: list[str], least_signals: int = 10) -> DataFrame:
    """The trial of the greatest MCC of each group, of those with signals enough (ties: the smallest
    subset by its number)."""
    best = F.max_by(F.struct("trial_id", "signals", "total_return", "mcc"), F.struct(F.col("mcc"), -F.col("trial_id"))).alias("b")
    return scores.where(F.col("signals") >= least_signals).groupBy(*by).agg(best).select(*by, "b.*")
