"""Chunks of a scan as a stream of batches."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickloom.operators import fold, scan

from .test_scan import rows, same


def test_short_chunks_share_batches(spark):
    made = scan.with_strength(rows(spark, 50), 3, chunk_bars=10)
    assert "InArrow" in (plan := made._jdf.queryExecution().toString()) and "FlatMap" not in plan


def test_no_table_leaves_a_chunk():
    number = np.concatenate([np.arange(1, n + 1) for n in (3, 1, 7, 2, 2, 9)])
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(number[a : a + size])], names=["__row"]) for a in range(0, len(number), size)]
        found = list(scan._whole_chunks(iter([*batches, batches[0].slice(0, 0)])))
        assert [n for _, cuts in found for n in np.diff(cuts)] == [3, 1, 7, 2, 2, 9]
        assert np.array_equal(np.concatenate([t.column("__row").to_numpy() for t, _ in found]), number)


def test_series_without_names_are_scanned(spark):
    bars = rows(spark, 60).withColumn("symbol", F.when(F.col("symbol") == "A", F.col("symbol")))
    want = fold.fold(bars, lambda b: {"e": fold.ema(b["close"], 5)}, ["e"])
    same(scan.smoothed(bars, 10, e=("close", "ema", 5)), want, ["e"])
