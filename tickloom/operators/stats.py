"""Statistical safeguards as column expressions and grouped windows."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tickloom.functions import scalar


def corrections(p_values: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """p_values with Bonferroni, Benjamini-Hochberg and Holm corrected columns, per group of keys."""
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(p, "test_id")
    n = F.count("*").over(every)
    rank = F.row_number().over(up)
    df = p_values.withColumns({"__n": n, "__k": rank})
    x = F.col(p)
    df = df.withColumns({"__bh": x * F.col("__n") / F.col("__k"), "__holm": x * (F.col("__n") - F.col("__k") + 1)})
    back = up.rowsBetween(0, Window.unboundedFollowing)
    on = up.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns(
        {"bonferroni": F.least(x * F.col("__n"), F.lit(1.0)), "benjamini_hochberg": F.least(F.min("__bh").over(back), F.lit(1.0)), "holm": F.least(F.max("__holm").over(on), F.lit(1.0))}
    ).drop("__n", "__k", "__bh", "__holm")


def mcc_interval(mcc: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Fisher-z interval of a correlation."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    half = F.lit(z) / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    low, high = F.tanh(F.atanh(mcc) - half), F.tanh(F.atanh(mcc) + half)
    few, sure = n <= 3, F.abs(mcc) >= 0.999
    return (
        F.when(few, F.lit(-1.0)).when(sure, mcc - 0.01 * z).otherwise(low).alias("ci_low"),
        F.when(few, F.lit(1.0)).when(sure, mcc + 0.01 * z).otherwise(high).alias("ci_high"),
    )


def detectable_effect(n: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.when(n <= 3, F.lit(1.0)).otherwise(F.tanh(F.lit(z) / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))))


def samples_needed(mcc: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    return F.greatest(F.ceil(F.pow(F.try_divide(F.lit(z), F.atanh(mcc)), F.lit(2.0))) + 3, F.lit(30)).cast("long")


def effective_size(n: Column, rho: Column, floor: float = 3.0) -> Column:
    """Samples left after lag-1 autocorrelation, `floor` at least."""
    return F.greatest(F.lit(floor), n * (1 - rho) / (1 + rho))


def effective_whole(n: Column, rho: Column) -> Column:
    """The same for reports, whole: one at least, one for a correlation of one, and all of a series
    under three. rho: sums of products over n, as lag_correlations gives it."""
    left = F.when(F.abs(rho) >= 1, F.lit(1.0)).otherwise(n * (1 - rho) / F.when(rho > -1, 1 + rho))
    return F.when(n < 3, n).otherwise(F.greatest(F.lit(1), F.floor(left))).cast("long")


#: Samples that suffice for inference, and that are more than marginal; the widest
#: interval of an MCC, and the least steadiness over folds.
ENOUGH, AMPLE, WIDE, STEADY = 100, 500, 0.3, 0.5


def quality_report(mcc: Column, auc: Column, n: Column, consistency: Column, profit_factor: Column) -> Column:
    """What a result rests on: its samples and the effect they could detect, the effect with its
    interval and whether it lies above zero, how steady it is, and advice in words. A missing
    consistency counts as steady."""
    least = detectable_effect(n)
    low, high = mcc_interval(mcc, n)
    steady = consistency.isNull() | (consistency >= STEADY)
    size = F.when(mcc >= 0.5, "large").when(mcc >= 0.3, "medium").when(mcc >= 0.1, "small").otherwise("trivial")
    found = F.array_compact(
        F.array(
            F.when(n < ENOUGH, F.lit("too few samples")).when(n < AMPLE, F.lit("samples are marginal")), F.when(mcc < least, F.lit("the effect is below what the samples can detect")),
            F.when(high - low > WIDE, F.lit("the interval is wide")), F.when(~steady, F.lit("folds disagree")),
        )
    )
    return F.struct(
        n.alias("samples"), least.alias("detectable"), ((n >= ENOUGH) & (mcc >= least)).alias("adequate"), mcc.alias("mcc"), auc.alias("roc_auc"), low, high, (high - low).alias("ci_width"),
        (low > 0).alias("significant"), size.alias("effect"), consistency.alias("consistency"), profit_factor.alias("profit_factor"), steady.alias("steady"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("adequate for inference"))).alias("advice"),
    )


def objective(mcc: Column, auc: Column, n: Column, consistency: Column, ci_low: Column) -> Column:
    """The scalar that searches maximise; minus infinity rejects."""
    shrink = n / (n + 50.0)
    base = shrink * mcc + (1 - shrink) * 0.03
    reject = mcc.isNull() | F.isnan(mcc) | (n < 100) | (auc < 0.5) | (mcc < 0.02) | (ci_low <= 0)
    kept = F.when(consistency < 0.5, base * (1 - 0.1 * (0.5 - consistency))).otherwise(base)
    return F.when(F.coalesce(reject, F.lit(True)), F.lit(float("-inf"))).otherwise(kept)


def composite_objective(mcc: Column, auc: Column, consistency: Column, tail: Column, n: Column) -> Column:
    score = 0.5 * (mcc + 1) / 2 + 0.2 * F.greatest(F.lit(0.0), (auc - 0.5) / 0.5) + 0.15 * consistency + 0.15 * tail
    return F.when(n < 100, F.lit(float("-inf"))).otherwise(score)


#: Counts of permuted labels that are held at a time.
BLOCK_CELLS = 4_000_000
ALTERNATIVES = ("greater", "less", "two-sided")


def permutation_test(counts: DataFrame, rounds: int = 1000, seed: int = 7, alternative: str = "greater") -> DataFrame:
    """counts: (test_id, tp, fp, tn, fn). With the predictions fixed, the hits of permuted labels
    are hypergeometric, so a round needs four counts and not the rows. Adds p_value."""
    import numpy as np
    import pyarrow as pa

    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")

    def run(batches):
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in ("tp", "fp", "tn", "fn")}
            out = []
            for i, (tp, fp, tn, fn) in enumerate(zip(c["tp"], c["fp"], c["tn"], c["fn"])):
                rng = np.random.default_rng([seed, int(batch.column("test_id")[i].as_py())])
                hits = rng.hypergeometric(tp + fn, fp + tn, tp + fp, rounds) if tp + fp else np.zeros(rounds, int)
                if alternative == "two-sided":
                    drawn, seen = mcc_of(hits, tp + fp - hits, fp + tn - (tp + fp - hits), tp + fn - hits), mcc_of(tp, fp, tn, fn)
                    as_far = np.abs(drawn) >= np.abs(seen) - 1e-12
                else:  # the MCC rises with the hits
                    as_far = hits >= tp if alternative == "greater" else hits <= tp
                out.append((1 + int(as_far.sum())) / (rounds + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "p_value"])

    return counts.mapInArrow(run, StructType([*counts.schema.fields, StructField("p_value", DoubleType())]))


def permutation_test_auc(rows: DataFrame, keys: list[str], rounds: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, roc_auc, p_value): the share of label permutations whose AUC is at least the observed
    one. rows: label and score; a group is known by its distinct scores, so only these, with their
    positives and negatives, reach the task, and a permutation draws positives for each of them."""
    import numpy as np
    import pyarrow as pa

    from tickloom.operators import backtest

    def auc(p, q):
        below = np.cumsum(q, axis=-1) - q
        return (p * (below + q / 2)).sum(axis=-1) / np.maximum(p.sum(axis=-1) * q.sum(axis=-1), 1)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("score")
        p, q = (group.column(c).to_numpy().astype(np.int64) for c in ("p", "q"))
        rng = np.random.default_rng([seed, int(group.column("test_id")[0].as_py())])
        seen, pairs = auc(p, q), p.sum() * q.sum()
        block, as_far = max(1, BLOCK_CELLS // max(1, len(p))), 0
        for at in range(0, rounds if pairs else 0, block):  # so many rounds at a time as the scores allow
            drawn = rng.multivariate_hypergeometric(p + q, int(p.sum()), min(block, rounds - at))
            as_far += int((auc(drawn, p + q - drawn) >= seen - 1e-12).sum())
        value = (1 + as_far) / (rounds + 1) if pairs else 1.0
        out = {k: group.column(k)[:1] for k in keys}
        return pa.table(out | {"roc_auc": pa.array([float(seen) if pairs else 0.5]), "p_value": pa.array([value])})

    found = backtest.by_score(rows, keys).withColumn("test_id", F.xxhash64(*keys).bitwiseAND(F.lit((1 << 31) - 1)))
    kinds = {f.name: f for f in found.schema.fields}
    return found.groupBy(*keys).applyInArrow(run, StructType([*[kinds[k] for k in keys], StructField("roc_auc", DoubleType()), StructField("p_value", DoubleType())]))


def mcc_of(tp, fp, tn, fn):
    """MCC of arrays of counts."""
    import numpy as np

    tp, fp, tn, fn = (np.asarray(x, float) for x in (tp, fp, tn, fn))
    square = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return np.where(square > 0, (tp * tn - fp * fn) / np.sqrt(np.where(square > 0, square, 1)), 0)


def acceleration(counts) -> float:
    """Jackknife acceleration of the MCC of (tp, fp, tn, fn). Leaving one sample out takes one from
    one of the four counts, so there are four values, each as often as its count."""
    import numpy as np

    left = np.maximum(np.tile(counts, (4, 1)) - np.eye(4), 0)
    values = mcc_of(*left.T)
    n = counts.sum()
    gap = (values * counts).sum() / max(n, 1) - values
    spread = (counts * gap**2).sum()
    return float((counts * gap**3).sum() / (6 * spread**1.5)) if spread > 0 else 0.0


def bootstrap_interval(counts: DataFrame, rounds: int = 2000, confidence: float = 0.95, seed: int = 7, method: str = "percentile") -> DataFrame:
    """Interval of the MCC, by percentiles or "bca" (bias-corrected and accelerated); a resample is
    multinomial in the four counts."""
    import numpy as np
    import pyarrow as pa

    normal = NormalDist()

    def shares(m, observed, cells) -> list[float]:
        ends = [(1 - confidence) / 2, (1 + confidence) / 2]
        under = float(np.mean(m < observed))
        if method != "bca" or not 0 < under < 1:
            return ends
        z0, a = normal.inv_cdf(under), acceleration(cells)
        moved = [z0 + normal.inv_cdf(e) for e in ends]
        return [normal.cdf(z0 + z / (1 - a * z)) for z in moved]

    def run(batches):
        for batch in batches:
            cells = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in ("tp", "fp", "tn", "fn")], axis=1)
            ends = []
            for x, test_id in zip(cells, batch.column("test_id").to_pylist()):
                drawn = np.random.default_rng([seed, int(test_id)]).multinomial(int(x.sum()), x / max(1.0, x.sum()), rounds) if x.sum() else np.zeros((rounds, 4))
                m = mcc_of(*drawn.T)
                ends.append(np.quantile(m, shares(m, mcc_of(*x), x)))
            low, high = np.array(ends).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=[*batch.schema.names, "boot_low", "boot_high"])

    return counts.mapInArrow(run, StructType([*counts.schema.fields, StructField("boot_low", DoubleType()), StructField("boot_high", DoubleType())]))


def effect_label(mcc: Column) -> Column:
    size = F.abs(mcc)
    return F.when(size < 0.1, "negligible").when(size < 0.3, "small").when(size < 0.5, "medium").otherwise("large")


def comprehensive_test(counts: DataFrame, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """Permutation p value, bootstrap interval, effect label, and whether both say it is not chance."""
    both = bootstrap_interval(permutation_test(counts, seed=seed), confidence=1 - alpha, seed=seed + 1000)
    apart = (F.col("boot_low") > 0) | (F.col("boot_high") < 0)
    return both.withColumn("effect", effect_label(F.col("mcc"))).withColumn("significant", (F.col("p_value") < alpha) & apart)


def autocorrelation(rows: DataFrame, x: str, keys: list[str], order: str, lag: int = 1) -> DataFrame:
    """Mean product of deviations `lag` rows apart over the population variance."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("__d", F.col(x) - F.avg(x).over(w))
    d = d.withColumn("__b", F.lag("__d", lag).over(w.orderBy(order)))
    n = F.count(x)
    return d.groupBy(*keys).agg(F.when(n > lag + 1, F.coalesce(F.try_divide(F.avg(F.col("__d") * F.col("__b")), F.var_pop(x)), F.lit(0.0))).otherwise(F.lit(0.0)).alias("rho"), n.alias("n"))


def lag_correlations(rows: DataFrame, x: str, keys: list[str], order: str, lags: int) -> DataFrame:
    """(keys, n, rho1 ... rho<lags>) in one window pass: sums of products of deviations over n times
    the population variance."""
    w = Window.partitionBy(*keys)
    d = rows.withColumn("__d", F.col(x) - F.avg(x).over(w))
    d = d.withColumns({f"__b{k}": F.lag("__d", k).over(w.orderBy(order)) for k in range(1, lags + 1)})
    rho = [F.coalesce(F.try_divide(F.sum(F.col("__d") * F.col(f"__b{k}")), F.count(x) * F.var_pop(x)), F.lit(0.0)).alias(f"rho{k}") for k in range(1, lags + 1)]
    return d.groupBy(*keys).agg(F.count(x).alias("n"), *rho)


def ljung_box(rhos: list[Column], n: Column) -> tuple[Column, Column]:
    """(q, p): statistic of autocorrelations at lags 1, 2, ..., and its p value by the cube-root
    normal approximation of chi-squared; (0, 1) for a series no longer than the lags."""
    total, k = F.lit(0.0), len(rhos)
    for lag, rho in enumerate(rhos, 1):
        total = total + F.try_divide(rho * rho, n - lag)
    q = F.when(n > k, n * (n + 2) * total).otherwise(F.lit(0.0))
    spread = 2 / (9 * k)
    z = (F.cbrt(q / k) - (1 - spread)) / spread**0.5
    return q.alias("q"), F.when(q > 0, 1 - scalar.normal_cdf(z)).otherwise(F.lit(1.0)).alias("p")
