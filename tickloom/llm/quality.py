"""Quality classifier: a factorisation machine over hashed words, structure statistics, metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairs by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), linear in the
number of inputs. Inputs: log counts of hashed words, bins of statistics of the text, and the
metadata column n_chars. Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, features

SLOTS, RANK, EPOCHS, BATCH, RATE, DECAY = 1 << 16, 8, 14, 64, 0.15, 1e-4
#: Bound of the labelled sample the model is fitted on; FOLDS: every FOLDS-th id hash is held out.
SAMPLE_ROWS, FOLDS, THRESHOLD = 8000, 5, 0.3


def inputs(found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: words scaled to length one, statistics to length one."""
    slots, counts, bins = found
    x = np.log1p(counts)
    x = x / max(1e-9, np.sqrt(x @ x)) if len(x) else x
    return np.concatenate([slots, bins]), np.concatenate([x, np.full(len(bins), 1 / np.sqrt(len(bins)))]).astype(np.float32)


class FactorisationMachine:
    def __init__(self, width: int, rank: int = RANK, seed: int = 7):
        self.w0, self.w = 0.0, np.zeros(width, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (width, rank)).astype(np.float32)

    def logits(self, slots: np.ndarray, x: np.ndarray, starts: np.ndarray, keep: bool = False):
        vx = self.v[slots] * x[:, None]
        s = features.sums(vx, starts)
        out = self.w0 + features.sums(self.w[slots] * x, starts) + 0.5 * (s * s - features.sums(vx * vx, starts)).sum(axis=1)
        return (out, s, vx) if keep else out

    def fit(self, rows: list, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss in shuffled batches. One class only: its constant."""
        rng = np.random.default_rng(seed)
        if not len(y) or y.min() == y.max():
            self.w0 = 0.0 if not len(y) else (6.0 if y[0] else -6.0)
            self.v[:] = 0
            return self
        self.w0 = float(np.log(y.mean() / (1 - y.mean())))
        gw, gv, g0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                slots = np.concatenate([rows[i][0] for i in pick])
                x = np.concatenate([rows[i][1] for i in pick])
                sizes = np.array([len(rows[i][0]) for i in pick])
                z, s, vx = self.logits(slots, x, np.cumsum(sizes) - sizes, keep=True)
                g = ((1 / (1 + np.exp(-z)) - y[pick]) / len(pick)).astype(np.float32)
                each = np.repeat(g, sizes)
                by = np.argsort(slots, kind="stable")
                touched, first = np.unique(slots[by], return_index=True)
                dw = features.sums((each * x)[by], first) + DECAY * self.w[touched]
                dv = features.sums((each[:, None] * x[:, None] * (np.repeat(s, sizes, axis=0) - vx))[by], first) + DECAY * self.v[touched]
                g0 += float(g.sum()) ** 2
                self.w0 -= RATE * float(g.sum()) / np.sqrt(g0)
                gw[touched] += dw * dw
                gv[touched] += dv * dv
                self.w[touched] -= RATE * dw / np.sqrt(gw[touched])
                self.v[touched] -= RATE * dv / np.sqrt(gv[touched])
        return self


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    rows, y = features.sample_features(features.labelled_sample(docs, labels, "quality", FOLDS, sample_rows), SLOTS, 4 * sample_rows)
    return FactorisationMachine(SLOTS + len(features.STATS) * features.BINS).fit([inputs(r) for r in rows], y)


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """docs with `fm_score`; every other column passes through. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast((model.w0, model.w, model.v))  # a fixed number of slots
    docs = docs.drop("fm_score", "fm_held_out", "fm_predicted")
    names = docs.columns

    def run(batches):
        fm = FactorisationMachine(1, 1)
        fm.w0, fm.w, fm.v = held.value
        words = features.WordSlots(SLOTS)
        for batch in common.slices(batches, 512):
            chars = batch.column(len(names) + 1).to_pylist()
            found = [inputs(features.features(t, c, words)) for t, c in zip(batch.column(len(names)).to_pylist(), chars)]
            sizes = np.array([len(f[0]) for f in found])
            z = fm.logits(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.cumsum(sizes) - sizes)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(p)], names=[*names, "fm_score"])

    text_name, chars_name = common.unused(docs, "fm_text", "fm_chars")
    given = docs.select("*", F.col("text").alias(text_name), features.char_count(docs).alias(chars_name))
    schema = docs.schema.add("fm_score", "double")
    return given.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `fm_score` (0 to 1), `fm_held_out` and `fm_predicted` (score >= 0.3).

    Defined results: an empty table gives no rows; null and empty texts are scored by their
    statistics; an n_chars that is no number counts as missing; without labels every score is 0.5; rows of equal doc_id are scored each; columns of
    other names pass through, those named like the three are replaced."""
    scored = score(docs, train(docs, labels))
    return scored.withColumn("fm_held_out", common.id_bucket(F.col("doc_id"), FOLDS) == 0).withColumn("fm_predicted", (F.col("fm_score") >= THRESHOLD).cast("int"))
