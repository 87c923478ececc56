"""Sparse features of whole texts: hashed words and binned structure statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tickloom.llm import common

_STRIPPED = b".,;:!?\"'()[]{}%$&*#|-_"
MEMO_WORDS = 300_000
BINS = 16
STATS = ("words", "word_length", "distinct", "top_word", "upper", "digits", "marks", "wide", "lines", "repeated_lines", "n_chars")
_CLASS = np.zeros((5, 256), np.float32)
_CLASS[0, ord("A") : ord("Z") + 1] = 1
_CLASS[1, ord("0") : ord("9") + 1] = 1
_CLASS[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_CLASS[3, 128:] = 1
_CLASS[4, 10] = 1


class WordSlots(dict):
    """Raw word -> hashed slot of its lower-case form without marks around it."""

    def __init__(self, slots: int):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: bytes) -> int:
        bare = word.lower().strip(_STRIPPED) or word
        slot = xxhash.xxh3_64_intdigest(bare) % self.slots
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = slot
        return slot


def features(text: str | None, n_chars: int | None, words: WordSlots) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word slots, their counts, statistics bins); a bin's slot is words.slots + stat * BINS + bin."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    n = len(found)
    slots, counts = np.unique(np.fromiter(map(words.__getitem__, found), np.int64, n), return_counts=True)
    size = max(1, len(raw))
    shares = _CLASS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    lines = raw.split(b"\n")
    top = int(counts.max()) if n else 0
    values = (
        np.log2(n + 1), len(raw) / max(1, n), 8 * len(slots) / max(1, n) * 2, 16 * top / max(1, n), 16 * shares[0], 64 * shares[1], 32 * shares[2], 32 * shares[3],
        np.log2(1 + 2000 * shares[4]), 15 * (1 - len(set(lines)) / len(lines)), 0 if n_chars is None else 1 + np.log2(1 + max(0, n_chars)),
    )
    bins = np.minimum(np.maximum(values, 0), BINS - 1).astype(np.int64)
    return slots, counts, words.slots + np.arange(len(STATS)) * BINS + bins


def char_count(docs: DataFrame) -> Column:
    """The column n_chars as a whole number; null where there is none, it is no number, or the column
    is of a kind that holds none."""
    known = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, (NumericType, StringType, BooleanType))
    return F.col("n_chars").try_cast("long") if known else F.lit(None).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, max_rows: int) -> DataFrame:
    """(doc_id, text, n_chars, y) of about max_rows labelled ids (twice as many at most) that
    are not held out, chosen by a hash of their id. A document labelled twice takes its mean label,
    halves up; rows without a label or an id are left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (common.id_bucket(F.col("doc_id"), folds) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    rows = common.stage(rows, "labelled")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    few = rows.where(lot < int((1 << 40) * min(1.0, max_rows / max(1, rows.count())))).limit(2 * max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", char_count(docs).alias("n_chars"))
    return texts.join(F.broadcast(few), "doc_id")  # few has 2 * max_rows rows at most


def sample_features(sample: DataFrame, slots: int, max_rows: int) -> tuple[list, np.ndarray]:
    """Features and labels of the sample, max_rows texts at most, gathered on the driver in doc_id
    order. Only features travel, never the texts."""

    def extract(batches):
        words = WordSlots(slots)
        for batch in common.slices(batches):
            found = [features(t, c, words) for t, c in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            arrays = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *arrays], names=["doc_id", "y", "slots", "counts", "bins"])

    got = sample.mapInArrow(extract, "doc_id long, y int, slots array<int>, counts array<int>, bins array<int>").limit(max_rows).toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    rows = [tuple(np.asarray(got.column(c)[i].values) for c in ("slots", "counts", "bins")) for i in range(got.num_rows)]
    return rows, got.column("y").to_numpy().astype(np.float64)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs (each of one value or more)."""
    return np.add.reduceat(values, starts, axis=0)
