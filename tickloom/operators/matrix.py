"""Scripts by data sets: each script is routed to its evaluator, all in one plan, and results are
kept in a table that a later run extends.

Scripts that ask for the same evaluator with the same length have the same signals, so a data set is
evaluated once for each distinct setting, not for each script.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tickloom.operators import backtest, indicators
from tickloom.operators import script as scripts_of

KEY = ["symbol", "interval"]
SIGNALS = ["main_value", "buy_signal", "sell_signal", "combined_signal"]
#: Most distinct settings of one plan, each a branch of it.
MAX_SETTINGS = 64
LENGTH = 14
Measure = Callable[[DataFrame], DataFrame]


def routed(scripts: DataFrame) -> DataFrame:
    """(script, kind, length): the evaluator of each (script, body) and its length, the default of the
    whole-number input named length, of 14 where there is none; kinds without a length have 0."""
    given = scripts_of.parameters(scripts).where("kind = 'int' AND lower(name) = 'length' AND default_value >= 1")
    length = given.groupBy("script").agg(F.min_by("default_value", "line_no").cast("int").alias("given"))
    kinds = scripts.select("script", F.coalesce(indicators.evaluator_of(F.col("script"), F.col("body")), F.lit("roc")).alias("kind"))
    none = F.col("kind").isin("money_flow", "gauge", "macd")
    return kinds.join(length, "script", "left").select("script", "kind", F.when(none, 0).otherwise(F.coalesce("given", F.lit(LENGTH))).alias("length"))


def combinations(scripts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every routed script with every (symbol, interval): two small catalogues, crossed."""
    return routed(scripts).crossJoin(datasets.select(*KEY).distinct())


def _signals(kind: str, length: int, bars: DataFrame) -> DataFrame:
    if kind == "money_flow":
        return indicators.money_flow(bars)
    if kind == "gauge":
        return indicators.gauge(bars)
    return indicators.directional(indicators.generic(bars, kind, length) if length else indicators.generic(bars, kind))


def dispatched(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Signals of indexed bars for each distinct (kind, length) of the wanted combinations, on the
    data sets that want it; columns kind and length tell them apart, and so does the interval, so that
    whatever groups by series treats each alone."""
    some = wanted.select("kind", "length").distinct().limit(MAX_SETTINGS + 1).collect()  # the branches of the plan
    if len(some) > MAX_SETTINGS:
        raise ValueError(f"more than {MAX_SETTINGS} settings in one plan")

    def branch(kind: str, length: int) -> DataFrame:
        sets = wanted.where((F.col("kind") == kind) & (F.col("length") == length)).select(*KEY).distinct()
        made = _signals(kind, length, bars.join(sets, KEY, "left_semi"))
        return made.select(*bars.columns, *SIGNALS).withColumns({"kind": F.lit(kind), "length": F.lit(length), "interval": F.concat_ws("#", "interval", F.lit(kind), F.lit(str(length)))})

    if not some:
        return branch("roc", LENGTH).where("false")
    return reduce(DataFrame.unionByName, [branch(r["kind"], r["length"]) for r in sorted(some)])


def measured(bars: DataFrame, wanted: DataFrame, measure: Measure) -> DataFrame:
    """wanted combinations with the measure of their signals. measure: signals to one row for each
    (symbol, interval)."""
    rows = measure(dispatched(bars, wanted))
    parts = F.split("interval", "#")
    rows = rows.withColumns({"interval": parts[0], "kind": parts[1], "length": parts[2].cast("int")})
    return wanted.join(rows, [*KEY, "kind", "length"])


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*KEY).agg(F.count("*").alias("bars"), F.count_if("buy_signal").alias("buys"), F.count_if("sell_signal").alias("sells"), F.avg("combined_signal").alias("mean_signal"))


def walk_forward(horizons: list[int], n_folds: int, embargo: int, min_train: int = 30, min_test: int = 100, interval_hours: float = 1.0) -> Measure:
    """A measure: classification and trades of each series over its folds."""

    def measure(signals: DataFrame) -> DataFrame:
        folds = backtest.fold_metrics(signals, horizons, n_folds, embargo, min_train, min_test, interval_hours=interval_hours)
        return backtest.roll_up(folds, KEY)

    return measure


class ResultStore:
    """Rows by key in a folder of Parquet, in numbered runs. A run is written by one job whose files
    become visible when it commits, and is never changed; of a key's rows those of the latest run
    hold. Two writers of one run cannot both succeed."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = StructType.fromDDL(schema)

    def _runs(self, begun: bool = False) -> list[int]:
        """Numbers of the committed runs, or of all that were begun."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[4:]) for n in names if n.startswith("run=") and (begun or files.exists(path(f"{self.path}/{n}/_SUCCESS"))))

    def rows(self) -> DataFrame:
        """The rows that hold."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        every = reduce(DataFrame.unionAll, [self.spark.read.schema(self.schema).parquet(f"{self.path}/run={n}").withColumn("__run", F.lit(n)) for n in runs])
        last = F.max("__run").over(Window.partitionBy(*self.keys))
        return every.withColumn("__last", last).where("__run = __last").drop("__run", "__last")

    def absent(self, wanted: DataFrame) -> DataFrame:
        """wanted without the keys that have rows."""
        return wanted.join(self.rows().select(*self.keys).distinct(), self.keys, "left_anti")

    def reused(self, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted keys."""
        return self.rows().join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def append(self, rows: DataFrame) -> int:
        """Write rows as the next run; its number."""
        number = max(self._runs(begun=True), default=-1) + 1
        rows.select(*self.schema.names).write.parquet(f"{self.path}/run={number}")
        return number

    def compact(self) -> None:
        """The rows that hold as one more run; older ones then only cost space."""
        self.append(self.rows())


def extend(store: ResultStore, bars: DataFrame, scripts: DataFrame, measure: Measure, datasets: DataFrame | None = None, again: bool = False) -> DataFrame:
    """Evaluate the combinations of scripts and data sets (those of the bars, unless given) that the
    store lacks, or all where `again` is set, append them, and return the stored rows of all wanted
    ones. A combination that gives no row (a series too short) stays absent."""
    wanted = combinations(scripts, datasets if datasets is not None else bars)
    todo = wanted if again else store.absent(wanted)
    if not todo.isEmpty():
        store.append(measured(bars, todo, measure))
    return store.reused(wanted)
