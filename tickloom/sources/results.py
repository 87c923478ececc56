"""Stored results: JSON documents with a matrix of rows, CSV tables, and text reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalar

#: What names one stored result.
KEY = ["file_name", "symbol", "interval"]
#: The metrics of a report by their titles, and which are shares in percent.
METRICS = {
    "MCC (primary)": "mcc", "ROC AUC": "roc_auc", "Classification Samples": "classification_samples", "Profit Factor": "profit_factor", "Win Rate": "win_rate",
    "Directional Accuracy": "directional_accuracy", "Extreme Move Capture": "tail_capture_rate", "Consistency Score": "consistency_score", "Sharpe Ratio": "sharpe_ratio",
    "Total Trades": "total_trades", "Max Drawdown": "max_drawdown",
}
SHARES = ("win_rate", "directional_accuracy", "tail_capture_rate")


#: The columns of the flat matrix table, in order.
MATRIX = (
    "indicator_name", "file_name", "symbol", "interval", "improved", "objective_best", "baseline_objective", "improvement_pf", "forecast_horizon", "total_trades", "winning_trades",
    "losing_trades", "win_rate", "profit_factor", "sharpe_ratio", "max_drawdown", "avg_holding_bars", "directional_accuracy", "mcc", "roc_auc", "classification_samples",
    "improvement_over_random", "tail_capture_rate", "consistency_score", "total_return", "avg_return", "optimization_time", "n_trials", "best_params", "original_params", "output_pine",
    "output_report",
)


def flat_matrix(rows: DataFrame) -> DataFrame:
    """Stored results as flat rows of MATRIX: a column of the row, else the measure of that name in the
    map `best_metrics`, else missing; maps as JSON with their keys in order."""
    kinds, metrics = dict(rows.dtypes), F.col("best_metrics") if "best_metrics" in rows.columns else F.create_map().cast("map<string,double>")

    def column(name: str) -> Column:
        if name not in kinds:
            return F.try_element_at(metrics, F.lit(name)).alias(name)
        x = F.col(name)
        return (F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x)))) if kinds[name].startswith("map") else x).alias(name)

    return rows.select(*map(column, MATRIX))


def documents(rows: DataFrame, by: list[str], run: Column) -> DataFrame:
    """One JSON text a group of rows: the run and its matrix, rows in the order of their fields.
    Group by what bounds a document, such as the script or the symbol."""
    body = F.to_json(F.struct(run.alias("run"), F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("matrix")))
    return rows.groupBy(*by).agg(body.alias("value"))


def matrix(texts: DataFrame, column: str, row_schema: str) -> DataFrame:
    """The run and the rows of stored JSON documents. Rows without their full key are left out, as
    are texts that are no such document."""
    parsed = F.from_json(F.col(column), f"run string, matrix array<struct<{row_schema}>>")
    rows = texts.select(parsed.alias("d")).select(F.col("d.run").alias("run"), F.inline("d.matrix"))
    complete = F.lit(True)
    for name in KEY:
        complete = complete & (F.coalesce(F.col(name), F.lit("")) != "")
    return rows.where(complete)


def write_json(rows: DataFrame, path: str, by: list[str], run: Column) -> None:
    documents(rows, by, run).select("value").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, row_schema: str, one_a_file: bool = False) -> DataFrame:
    """Rows of stored documents: one on each line, or each file one document over several lines."""
    return matrix(spark.read.text(path, wholetext=one_a_file), "value", row_schema)


def write_csv(rows: DataFrame, path: str) -> None:
    """Flat columns as they are; maps, arrays and structs as JSON text."""
    nested = ("map", "array", "struct")
    flat = [F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").csv(path, header=True)


def comparison(reports: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, metric, before, after) from the comparison table of text reports: the lines between its
    title and the next part, in cells parted by two blanks or more. Shares in percent become
    fractions; what is no number is missing; lines of other titles are left out."""
    lines = F.transform(F.split(F.col(column), r"\r?\n"), F.trim)
    title = F.array_position(lines, "PERFORMANCE COMPARISON")
    below = F.when(title > 0, F.slice(lines, title.cast("int") + 1, F.size(lines)))
    ends = F.array_position(F.transform(below, lambda x: F.startswith(x, F.lit("Overall Performance")) | F.startswith(x, F.lit("MULTI-TIMEFRAME"))), True)
    inside = F.when(ends > 0, F.slice(below, 1, ends.cast("int") - 1)).otherwise(below)
    cells = F.filter(F.transform(inside, lambda x: F.split(x, r"\s{2,}")), lambda c: (F.size(c) >= 4) & ~F.startswith(c[0], F.lit("Metric")))

    short = F.create_map(*[F.lit(x) for pair in METRICS.items() for x in pair])
    rows = reports.select(*keep, F.explode(cells).alias("c"))
    rows = rows.select(*keep, F.try_element_at(short, F.col("c")[0]).alias("metric"), *[scalar.report_number(F.col("c")[k]).alias(n) for k, n in ((1, "before"), (2, "after"))]).where("metric IS NOT NULL")
    unit = F.when(F.col("metric").isin(*SHARES), 100.0).otherwise(1.0)
    return rows.withColumns({n: F.col(n) / unit for n in ("before", "after")})


def settings(reports: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """(keep, name, value) from the settings of text reports: `name: value` lines up to a blank one."""
    block = F.regexp_extract(F.regexp_replace(F.col(column), "\r", ""), r"(?m)^\s*Optimization config:[ \t]*\n((?:[ \t]*\S.*\n?)*)", 1)
    line = F.explode(F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))).alias("line")
    return reports.select(*keep, line).select(*keep, F.trim(F.regexp_extract("line", r"^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))


def read_zip(spark: SparkSession, path: str, row_schema: str, ending: str = ".json") -> DataFrame:
    """Rows of stored documents in zip archives (a file or a folder of them), as read_json gives them
    from single files: each member of the ending is a document. Archives that cannot be opened, and
    members that are no such document, have no rows."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(raw.as_py()))
                except zipfile.BadZipFile:
                    continue
                for name in sorted(n for n in archive.namelist() if n.lower().endswith(ending)):
                    text = archive.read(name).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([text], pa.string())], names=["member", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    return matrix(files.mapInArrow(members, "member string, value string"), "value", row_schema)
