"""As-of join: the last row of another series that is known by a time, without a range join.

Both sides are united in time order and the last known row is carried on. Time is cut into spans: what
enters a span comes from one row a span, so no group holds a whole series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions import scalar

#: Seconds of a span.
SPAN = 90 * 86400


def _seconds(column: str):
    """Seconds of a time as it reads, of either kind of timestamp."""
    at = F.col(column)
    return F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """left with `columns` of the last row of right with equal keys whose time is not after its own;
    missing where there is none. Of right rows at one time that with the greatest columns holds. Rows
    with a null key or time match nothing; repeated left rows stay."""
    kept = [c for c in left.columns if c not in columns]
    sound = F.col("__t").isNotNull()
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    one = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*kept).alias("__row"), F.lit(None).cast(right.select(F.struct(*columns).alias("v")).schema["v"].dataType).alias("__v"))
    two = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), F.struct(*columns).alias("__v")).where(sound)
    both = one.unionAll(two).withColumn("__span", F.floor(_seconds("__t") / span))
    at = [*keys, "__span"]
    ends = both.groupBy(*at).agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    entering = ends.withColumn("__in", F.last("__end", ignorenulls=True).over(before)["__v"]).drop("__end")
    order = Window.partitionBy(*at).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__last", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    matched = [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in at]
    joined = met.join(entering.select(*[F.col(k).alias(f"e_{k}") for k in at], "__in"), matched, "left")
    found = F.when(sound, F.coalesce("__last", "__in"))
    return joined.select("__row.*", *[found[c].alias(c) for c in columns])


def security(bars: DataFrame, other: DataFrame, symbol: str | None, columns: dict[str, str], span: int = SPAN) -> DataFrame:
    """bars with columns (new name: column) of another series of bars, as known when each bar ends:
    from the last bar of the other that has ended by then, so nothing is seen ahead. symbol: whose
    bars; None takes each bar's own symbol, of another interval."""
    ended = lambda df: df.withColumn("__end", F.col("timestamp") + F.make_dt_interval(secs=scalar.interval_seconds(F.col("interval"))))
    right = ended(other if symbol is None else other.where(F.col("symbol") == symbol))
    right = right.select(F.col("symbol") if symbol is None else F.lit(symbol).alias("symbol"), "__end", *[F.col(c).alias(n) for n, c in columns.items()])
    left = ended(bars).withColumn("__key", F.col("symbol") if symbol is None else F.lit(symbol))
    return as_of(left, right.withColumnRenamed("symbol", "__key"), ["__key"], "__end", "__end", list(columns), span).drop("__end", "__key")
