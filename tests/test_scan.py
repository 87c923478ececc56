"""Scans over chunks against the fold over whole series, gaps and short chunks included."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import adaptive, affine, fold, scan

GONE = 0.2


def rows(spark, n, seed=1, symbols=("A", "B")):
    lot = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 + lot.normal(0, 1, n).cumsum()
        for k in range(n):
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)
            if lot.random() < 0.9:  # times without a bar
                c = None if lot.random() < GONE or 40 < k < 60 else float(close[k])
                out.append((s, "1h", at, *([c] * 4 if c is None else [c, c + 1, c - 1, c]), float(lot.integers(1, 9))))
    return spark.createDataFrame(out, "symbol string, interval string, timestamp timestamp_ntz, open double, high double, low double, close double, volume double")


def same(got, want, columns):
    a, b = ({(r.symbol, r.timestamp): [r[c] for c in columns] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and a
    for k, values in b.items():
        for x, y in zip(a[k], values):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9 * max(1, abs(y))), (k, a[k], values)


@pytest.mark.parametrize("chunk", [20, 1000])
def test_chunks_equal_whole_series(spark, chunk):
    bars = rows(spark, 320)
    with_means = fold.fold(bars, lambda b: {"e": fold.ema(b["close"], 12), "r": fold.rma(b["volume"], 5)}, ["e", "r"])
    same(scan.smoothed(bars, chunk, e=("close", "ema", 12), r=("volume", "rma", 5)), with_means, ["e", "r"])
    same(scan.with_strength(bars, 14, chunk_bars=chunk), fold.fold(bars, lambda b: {"rsi": fold.rsi(b["close"], 14)}, ["rsi"]), ["rsi"])
    same(scan.with_range(bars, 14, chunk_bars=chunk), fold.fold(bars, lambda b: {"atr": fold.rma(fold.true_range(b["high"], b["low"], b["close"]), 14)}, ["atr"]), ["atr"])


def test_nested_and_adaptive_averages(spark):
    bars = rows(spark, 320, 2)
    names = ["line", "signal", "histogram"]
    same(scan.with_macd(bars, chunk_bars=20), fold.fold(bars, lambda b: dict(zip(names, fold.macd(b["close"], 12, 26, 9))), names), names)
    names = ["kama", "vidya", "frama", "laguerre"]
    want = fold.fold(adaptive.averages(bars), lambda b: {"laguerre": adaptive.laguerre(b["close"])}, ["laguerre"])
    same(scan.with_adaptive(bars, chunk_bars=20), want, names)


def test_fisher_and_cooldown(spark):
    bars = rows(spark, 320, 3)
    want = fold.fold(adaptive.with_place(bars), lambda b: {"fisher": adaptive.fisher(b["place"])}, ["fisher"])
    same(scan.with_fisher(bars, chunk_bars=20), want, ["fisher"])
    edged = bars.withColumn("up", (F.pmod(F.hash("timestamp", "symbol"), F.lit(3)) == 0).cast("int"))
    want = fold.fold(edged, lambda b: {"is_up": fold.cooldown(b["up"] == 1, 7)}, ["is_up"])
    same(scan.cooled(edged, ["up"], 7, chunk_bars=10), want, ["is_up"])


def test_nothing_and_one_bar(spark):
    bars = rows(spark, 320)
    assert scan.smoothed(bars.limit(0), e=("close", "ema", 3)).collect() == []
    one = bars.where("symbol = 'A'").orderBy("timestamp").limit(1)
    assert scan.with_strength(one, 1).first()["rsi"] == fold.fold(one, lambda b: {"rsi": fold.rsi(b["close"], 1)}, ["rsi"]).first()["rsi"]


def test_maps_compose_for_any_cut():
    lot = np.random.default_rng(5)
    x = lot.normal(0, 1, 300)
    x[lot.random(300) < 0.3] = np.nan
    x[:7] = np.nan
    for kind, data in ((affine.Mean(0.2, 5), x), (affine.Follow(), np.stack([x, lot.random(300)])), (affine.Filters(), x), (affine.Decay(0.5), x), (affine.Clamp(0.33, 0.9, 0.6), x), (affine.Cooldown(7), x)):
        whole = kind.run(data, kind.start)
        for _ in range(20):
            cuts = [0, *sorted(lot.integers(0, 301, 15).tolist()), 300]
            state, parts = kind.start, []
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    parts.append(kind.run(data[..., a:b], state))
                    state = kind.pass_on(state, kind.sum_up(data[..., a:b]))
            assert np.allclose(np.concatenate(parts), whole, rtol=0, atol=1e-9, equal_nan=True)
    assert np.allclose(affine.Mean(0.2, 5).run(x, affine.Mean.start), fold.smooth(x, 0.2, 5), equal_nan=True)
    assert np.allclose(affine.Filters().run(x, affine.Filters.start), adaptive.laguerre(x))


def test_no_group_holds_a_whole_series(spark):
    bars = rows(spark, 320).withColumnRenamed("open", "kept").withColumnRenamed("kept", "open")
    sizes = bars.groupBy("symbol", scan.chunk_of(bars, 20).alias("c")).count()
    assert sizes.agg({"count": "max"}).first()[0] <= 20 and sizes.count() >= 32
