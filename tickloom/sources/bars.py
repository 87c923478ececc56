"""Bar relations: schema, feeds and files in, ticks to bars, data-set catalogue, holdout split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["symbol", "interval"]
BAR_SCHEMA = "symbol string, interval string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"
PRICES = ("open", "high", "low", "close", "volume")
#: The feed's twelve fields, in order; all but the first come as text.
FEED_FIELDS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
_UNITS = {"1h": "1 hour", "4h": "4 hours", "1d": "1 day"}


def ticks_to_bars(ticks: DataFrame, symbol: Column, time: Column, price: Column, size: Column, interval: str) -> DataFrame:
    """Tumbling bars; open and close are the prices at the first and last time (ties: by price)."""
    tick = ticks.select(symbol.cast("string").alias("symbol"), time.alias("t"), price.alias("p"), size.cast("double").alias("v"))
    at = F.struct("t", "p")
    made = tick.groupBy("symbol", F.window("t", _UNITS[interval]).alias("w")).agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.sum("v").alias("volume")
    )
    return made.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("timestamp"), *PRICES)


def event_bars(spark: SparkSession, sf_dir: str, interval: str = "4h", by_type: bool = True) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    return ticks_to_bars(events, symbol, F.col("ts"), F.col("value"), F.lit(1.0), interval)


#: Ticks of a task where whole series are dealt to tasks.
TASK_TICKS = 100_000


def lineitem_bars(spark: SparkSession, sf_dir: str, by_series: bool = False) -> DataFrame:
    """Daily bars of unit prices per supplier. by_series deals the ticks by supplier, to as many tasks
    as they need: bars, windows and groups of a series then share one exchange and one sort."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    ticks = rows.select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_shipdate").alias("timestamp"), price.alias("p"), order.alias("at"), F.col("l_quantity").alias("v"))
    if by_series:
        ticks = ticks.repartition(1 + rows.count() // TASK_TICKS, "symbol")
    return (
        ticks.groupBy("symbol", F.lit("1d").alias("interval"), "timestamp")
        .agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").alias("volume"))
    )


def indexed(bars: DataFrame) -> DataFrame:
    """bars with bar_index, from 0 within each series."""
    return bars.withColumn("bar_index", (F.row_number().over(Window.partitionBy(*KEY).orderBy("timestamp")) - 1).cast("long"))


def project_feed(rows: DataFrame, symbol: Column, interval: Column, *also: str) -> DataFrame:
    """Feed rows of twelve fields to bars: milliseconds to time, text to numbers. `also` are kept."""
    return rows.select(
        symbol.alias("symbol"), interval.alias("interval"), F.expr("CAST(timestamp_millis(open_time) AS TIMESTAMP_NTZ)").alias("timestamp"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in PRICES], *also
    )


def first_arrivals(rows: DataFrame, arrival: str) -> DataFrame:
    """One bar for each time: the first that arrived."""
    w = Window.partitionBy(*KEY, "timestamp").orderBy(arrival)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def read_csv_bars(spark: SparkSession, folder: str, symbols: list[str] | None = None, intervals: list[str] | None = None) -> DataFrame:
    """All SYMBOL_INTERVAL.csv of a folder; names that do not match are skipped, as are unwanted sets."""
    raw = spark.read.schema("timestamp timestamp_ntz, open double, high double, low double, close double, volume double").csv(folder, header=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    bars = raw.select(*_name_parts(name), *raw.columns).where("symbol <> ''")
    return only(bars, symbols, intervals)


def _name_parts(name: Column) -> tuple[Column, Column]:
    pattern = r"^([A-Z0-9]+)_([0-9]+[mhdwM])\.csv$"
    return F.regexp_extract(name, pattern, 1).alias("symbol"), F.regexp_extract(name, pattern, 2).alias("interval")


def datasets(names: DataFrame, column: str) -> DataFrame:
    """Sorted (symbol, interval) of file names that follow the naming rule."""
    return names.select(*_name_parts(F.col(column))).where("symbol <> ''").distinct().orderBy("symbol", "interval")


def only(bars: DataFrame, symbols: list[str] | None = None, intervals: list[str] | None = None) -> DataFrame:
    """Filter by symbols and intervals; an empty list keeps all."""
    for column, wanted in (("symbol", symbols), ("interval", intervals)):
        if wanted:
            bars = bars.where(F.col(column).isin(list(wanted)))
    return bars


def has_bars(bars: DataFrame, symbol: str, interval: str) -> bool:
    """Whether a set has any bar; partitions of others are not read, and one row ends the search."""
    return not only(bars, [symbol], [interval]).limit(1).isEmpty()


def write_bars(bars: DataFrame, path: str, form: str = "parquet") -> None:
    bars.repartition(*KEY).sortWithinPartitions(*KEY, "timestamp").write.partitionBy(*KEY).mode("overwrite").format(form).option("header", "true").save(path)


def symbol_name(text: Column, quote: str = "USDT") -> Column:
    """Upper case, with the quote currency appended where it is missing."""
    upper = F.upper(F.trim(text))
    return F.when(upper.endswith(quote), upper).otherwise(F.concat(upper, F.lit(quote)))


def symbol_list(text: Column, quote: str = "USDT") -> Column:
    """Names in a text of commas and spaces, normalised, first occurrences only."""
    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda x: x != "")
    return F.array_distinct(F.transform(parts, lambda x: symbol_name(x, quote)))


def instruments(info: Column, quote: str = "USDT") -> Column:
    """Sorted names of the tradable spot instruments in an exchange description (JSON text)."""
    schema = "symbols array<struct<symbol string, quoteAsset string, status string, isSpotTradingAllowed boolean>>"
    rows = F.from_json(info, schema)["symbols"]
    good = F.filter(rows, lambda x: (x["quoteAsset"] == quote) & (x["status"] == "TRADING") & F.coalesce(x["isSpotTradingAllowed"], F.lit(False)))
    return F.sort_array(F.transform(good, lambda x: x["symbol"]))


def holdout_split(bars: DataFrame, ratio: float, gap: int) -> DataFrame:
    """indexed bars with `part`: train, gap or holdout; sets too small for both are train alone."""
    n = F.count("*").over(Window.partitionBy(*KEY))
    hold = F.floor(n * F.lit(ratio)).cast("long")
    train = n - hold - gap
    usable = (hold >= max(200, gap)) & (train >= max(200, 2 * gap))
    i = F.col("bar_index")
    return bars.withColumn("part", F.when(~usable | (i < train), "train").when(i < train + gap, "gap").otherwise("holdout"))
