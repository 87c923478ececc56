"""Series with memory over any number of bars: a parallel prefix scan.

A series is cut into chunks of time that hold a bounded number of bars, as bars of an interval are
apart by it. Each chunk is summed up as an affine map of the state; the maps of a series, one row a
chunk, are composed in time order; each chunk then meets the state that enters it. Chunks stream
through Arrow in order, many short ones in a batch; a task holds one chunk at most beside a batch, and
the whole is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from tickloom.functions import scalar
from tickloom.operators import adaptive, fold
from tickloom.operators.affine import Clamp, Cooldown, Decay, Filters, Follow, Mean

#: Most bars of a chunk.
CHUNK_BARS = 65_536
Arrays = dict[str, np.ndarray]
Row = dict[str, float]


def chunk_of(bars: DataFrame, chunk_bars: int) -> Column:
    """The number of the chunk of time that a bar lies in: chunk_bars lengths of its interval. Bars of
    an interval without a length (a name that is none) form one chunk."""
    at = F.col("timestamp")
    days = F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    seconds = days if dict(bars.dtypes)["timestamp"] == "timestamp_ntz" else F.unix_seconds(at)
    return F.coalesce(F.floor(seconds / (chunk_bars * scalar.interval_seconds(F.col("interval")))), F.lit(0)).cast("long")


def scan(bars: DataFrame, inputs: Callable[[Arrays, Row | None], Arrays], kinds: dict, finish: Callable[[Arrays, Arrays], Arrays], columns: list[str], chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars (each timestamp of a series once) with `columns`.

    inputs: the arrays of successive bars and the bar before them (None at the start) to one array
    for each of `kinds` (name to recursion); finish: the bars' arrays and each recursion's values to
    the columns (missing: NaN in, NULL out; names that start with is_ are boolean). Only a chunk's first bar may depend on the bar before."""
    held = _in_chunks(bars, chunk_bars)
    numbers = [f.name for f in bars.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")]
    names, nested = bars.columns, pa.list_(pa.list_(pa.float64()))

    def arrays(rows: pa.Table) -> Arrays:
        return {c: rows.column(c).to_numpy().astype(float) for c in numbers}

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_chunks(batches):
            b, sums = arrays(rows), []
            for i, j in zip(cuts, cuts[1:]):
                made = inputs({c: x[i:j] for c, x in b.items()}, None)
                sums.append([[float(v) for v in kind.sum_up(made[c][..., 1:])] for c, kind in kinds.items()])
            every = np.stack([b[c] for c in numbers], axis=1)
            ends = [pa.array(every[at].tolist(), pa.list_(pa.float64())) for at in (cuts[:-1], cuts[1:] - 1)]
            chunk = rows.column("__chunk").combine_chunks().take(pa.array(cuts[:-1]))
            yield pa.RecordBatch.from_arrays([chunk, *ends, pa.array(sums, nested)], names=["__chunk", "first", "last", "sums"])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_series = None
        for batch in batches:
            entering = []
            for r in batch.to_pylist():
                if (r["__chunk"]["symbol"], r["__chunk"]["interval"]) != one_series:
                    one_series = r["__chunk"]["symbol"], r["__chunk"]["interval"]
                    before, states = None, {c: kind.start for c, kind in kinds.items()}
                entering.append((before, [list(states[c]) for c in kinds]))
                one = inputs({c: np.array([v]) for c, v in zip(numbers, r["first"])}, dict(zip(numbers, before)) if before else None)
                for (c, kind), rest in zip(kinds.items(), r["sums"]):
                    states[c] = kind.pass_on(kind.pass_on(states[c], kind.sum_up(one[c])), rest)
                before = r["last"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__chunk"), pa.array([x for x, _ in entering], pa.list_(pa.float64())), pa.array([x for _, x in entering], nested)], names=["__of", "before", "states"]
            )

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _whole_chunks(batches):
            b, parts = arrays(rows), {c: [] for c in columns}
            before, states = (rows.column(c).take(pa.array(cuts[:-1])).to_pylist() for c in ("before", "states"))
            for i, j, was, entering in zip(cuts, cuts[1:], before, states):
                own = {c: x[i:j] for c, x in b.items()}
                made = inputs(own, dict(zip(numbers, was)) if was else None)
                values = {c: kind.run(made[c], tuple(s)) for (c, kind), s in zip(kinds.items(), entering)}
                for c, v in finish(own, values).items():
                    parts[c].append(v)
            chunk = rows.column("__chunk").combine_chunks()
            out = pa.table({c: chunk.field(c) if c in fold.KEY else rows.column(c) for c in names})
            for c, found in parts.items():
                v = np.concatenate(found)
                kind = pa.bool_() if c.startswith("is_") else pa.float64()
                out = out.append_column(c, pa.array(v.astype(bool) if c.startswith("is_") else v, kind, from_pandas=True))
            yield from out.to_batches()

    doubles = ArrayType(DoubleType())
    chunk_type, states_type = held.schema["__chunk"].dataType, ArrayType(doubles)
    sums = held.mapInArrow(sum_up, StructType([StructField("__chunk", chunk_type), StructField("first", doubles), StructField("last", doubles), StructField("sums", states_type)]))
    ordered = sums.repartition("__chunk.symbol", "__chunk.interval").sortWithinPartitions("__chunk")
    states = ordered.mapInArrow(compose, StructType([StructField("__of", chunk_type), StructField("before", doubles), StructField("states", states_type)]))
    met = held.join(states, (F.col("__lot") == F.xxhash64("__of")) & (F.col("__chunk") == F.col("__of")) & (F.col("__row") == 1), "left").drop("__of").sortWithinPartitions("__lot", "__chunk", "__row")
    return met.mapInArrow(done, StructType([*bars.schema.fields, *[StructField(c, BooleanType() if c.startswith("is_") else DoubleType()) for c in columns]]))


def _in_chunks(bars: DataFrame, chunk_bars: int) -> DataFrame:
    """bars with __chunk and the number of the bar in it from 1, __row, in partitions of whole chunks in
    order. A chunk is one struct, as missing names in it are equal to each other, and holds the series'
    names; by its hash, __lot, rows are sorted fast."""
    chunk = F.struct(*fold.KEY, chunk_of(bars, chunk_bars).alias("number"))
    number = F.row_number().over(Window.partitionBy("__lot", "__chunk").orderBy("timestamp"))
    held = bars.withColumn("__chunk", chunk).drop(*fold.KEY).withColumn("__lot", F.xxhash64("__chunk"))
    return held.withColumn("__row", number).sortWithinPartitions("__lot", "__chunk", "__row")


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Ordered rows as tables that no chunk leaves, with where their chunks start, and their end: many
    short chunks come in one table, and one chunk at most is held back."""

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        return rows, np.append(np.flatnonzero(rows.column("__row").to_numpy() == 1), rows.num_rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("__row").to_numpy() == 1)
        if len(starts):
            ready = [x for x in (*held, batch.slice(0, int(starts[-1]))) if x.num_rows]
            if ready:
                yield cut(ready)
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
    held = [x for x in held if x.num_rows]
    if held:
        yield cut(held)


def smoothed(bars: DataFrame, chunk_bars: int = CHUNK_BARS, **averages: tuple[str, str, int]) -> DataFrame:
    """bars with averages: new column = (source column, "ema" or "rma", length)."""
    kinds = {c: Mean(2 / (n + 1) if kind == "ema" else 1 / n, n) for c, (_, kind, n) in averages.items()}
    return scan(bars, lambda b, _: {c: b[source] for c, (source, _, _) in averages.items()}, kinds, lambda _, made: made, list(averages), chunk_bars)


def _after(x: np.ndarray, before: float | None) -> np.ndarray:
    """Each row's predecessor; the first row of a series is its own."""
    return np.concatenate([x[:1] if before is None else [before], x[:-1]])


def with_strength(bars: DataFrame, n: int = 14, column: str = "rsi", chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with the relative strength of smoothed gains and losses of close."""

    def moves(b: Arrays, before: Row | None) -> Arrays:
        d = b["close"] - _after(b["close"], before["close"] if before else None)
        return {"gain": np.maximum(d, 0), "loss": np.maximum(-d, 0)}

    def strength(_: Arrays, made: Arrays) -> Arrays:
        gain, loss = made["gain"], made["loss"]
        ratio = np.where(loss == 0, 100.0, gain / np.where(loss == 0, 1.0, loss))
        return {column: 100 - 100 / (1 + ratio)}

    return scan(bars, moves, {"gain": Mean(1 / n, n), "loss": Mean(1 / n, n)}, strength, [column], chunk_bars)


def with_range(bars: DataFrame, n: int = 14, column: str = "atr", chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with the smoothed true range."""

    def ranges(b: Arrays, before: Row | None) -> Arrays:
        was = _after(b["close"], before["close"] if before else None)
        return {column: np.maximum(b["high"] - b["low"], np.maximum(np.abs(b["high"] - was), np.abs(b["low"] - was)))}

    return scan(bars, ranges, {column: Mean(1 / n, n)}, lambda _, made: made, [column], chunk_bars)


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with line, signal and histogram; the mean of the line is a second scan over the first."""
    both = smoothed(bars, chunk_bars, __fast=("close", "ema", fast), __slow=("close", "ema", slow))
    lined = both.withColumn("line", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return smoothed(lined, chunk_bars, signal=("line", "ema", signal)).withColumn("histogram", F.col("line") - F.col("signal"))


def with_adaptive(bars: DataFrame, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with kama, vidya and frama, and the laguerre share of close. Their gains are windows of a
    few rows, which Spark streams; only what has memory is scanned."""
    names = ("kama", "vidya", "frama")
    gained = adaptive.with_gains(bars)
    kinds = {n: Follow() for n in names} | {"laguerre": Filters()}
    inputs = lambda b, _: {n: np.stack([b["close"], b[f"{n}_gain"]]) for n in names} | {"laguerre": b["close"]}
    return scan(gained, inputs, kinds, lambda _, made: made, list(kinds), chunk_bars)


def with_fisher(bars: DataFrame, n: int = 9, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with Fisher's transform of the smoothed place of each bar in the range of n."""
    held = scan(adaptive.with_place(bars, n), lambda b, _: {"__held": b["place"]}, {"__held": Clamp(0.33, 0.67, 0.999)}, lambda _, made: made, ["__held"], chunk_bars)

    def bent(b: Arrays, _: Row | None) -> Arrays:
        return {"fisher": 0.5 * np.log((1 + b["__held"]) / (1 - b["__held"]))}

    return scan(held, bent, {"fisher": Decay(0.5)}, lambda _, made: made, ["fisher"], chunk_bars).drop("__held", "place")


def cooled(bars: DataFrame, edges: list[str], n: int, chunk_bars: int = CHUNK_BARS) -> DataFrame:
    """bars with is_<name> for each numeric column of edges (over zero): those accepted, n bars apart."""
    names = {f"is_{e}": e for e in edges}
    return scan(bars, lambda b, _: {c: b[e] for c, e in names.items()}, {c: Cooldown(n) for c in names}, lambda _, made: made, list(names), chunk_bars)
