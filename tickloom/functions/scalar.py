"""Scalar functions: missing in, missing out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "3d", "1w", "1M")


def both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def maximum(a: Column, b: Column) -> Column:
    return both(a, b, F.greatest(a, b))


def minimum(a: Column, b: Column) -> Column:
    return both(a, b, F.least(a, b))


def log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def soft_tanh(x: Column) -> Column:
    return F.when(x.isNotNull(), F.tanh(F.greatest(F.least(x, F.lit(20.0)), F.lit(-20.0))))


def normal_cdf(x: Column) -> Column:
    """The coarse approximation by tanh."""
    return 0.5 * (1 + F.tanh(0.79788 * x))


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile for 0 < p < 1, by rational approximations of centre and tails.

    Fixed values: coefficients of the published approximation (relative error 1.15e-9)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(x: Column, k: tuple) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q = p - 0.5
    centre = poly(q * q, a) * q / poly(q * q, b)
    low, high = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, poly(low, c) / poly(low, d)).when(p > 1 - 0.02425, -poly(high, c) / poly(high, d)).otherwise(centre)


def interval_seconds(text: Column) -> Column:
    """Length of an interval name in seconds; a month counts 30 days."""
    unit = F.create_map(*[F.lit(x) for kv in {"m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}.items() for x in kv])
    n = F.regexp_extract(text, r"^(\d+)[mhdwM]$", 1).try_cast("long")
    return n * F.try_element_at(unit, F.regexp_extract(text, r"^\d+([mhdwM])$", 1))


def duration_text(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.format_string("%.0f minutes", hours * 60))
        .when(hours < 24, F.format_string("%.1f hours", hours))
        .when(hours < 168, F.format_string("%.1f days", hours / 24))
        .otherwise(F.format_string("%.1f weeks", hours / 168))
    )


def value_text(x: Column) -> Column:
    size = F.abs(x)
    return F.when((size < 1e-4) & (size > 0), F.format_string("%.2e", x)).when(size < 1, F.format_string("%.4f", x)).otherwise(F.format_string("%.2f", x))


def report_number(text: Column) -> Column:
    """A number in a report: thousands marks and percent signs go, anything else is missing."""
    return F.regexp_replace(F.trim(text), "[,%]", "").try_cast("double")


def safe_tag(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]", "_")


def label_parts(text: Column) -> tuple[Column, Column, Column]:
    """indicator:SYMBOL@interval."""
    name, rest = F.split_part(text, F.lit(":"), F.lit(1)), F.regexp_extract(text, r"^[^:]*:(.*)$", 1)
    return name.alias("indicator"), F.split_part(rest, F.lit("@"), F.lit(1)).alias("symbol"), F.split_part(rest, F.lit("@"), F.lit(2)).alias("interval")


def mcc_label(mcc: Column) -> Column:
    return (
        F.when(mcc >= 0.7, "very strong positive").when(mcc >= 0.5, "strong positive").when(mcc >= 0.3, "moderate positive").when(mcc >= 0.1, "weak positive")
        .when(mcc > -0.1, "none").when(mcc > -0.3, "weak negative").otherwise("negative")
    )
