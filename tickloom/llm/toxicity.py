"""Toxicity by a classifier chain of linear models.

The labels know one category, `toxic`. Two finer ones are weak labels, given by the words that the
labelled sample marks: `insult` (a toxic text with a marker word) and `sustained` (a toxic text with
SUSTAINED or more of them). The chain predicts insult, sustained, toxic in this order; each later
model also sees the earlier probabilities (as logits). While training these come from out-of-fold
predictions, so a later model learns how far an unseen text's earlier probability can be trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, features

SLOTS, KEPT_SLOTS, CV, STEPS, RATE, DECAY = 1 << 18, 1000, 4, 300, 0.5, 1e-3
SAMPLE_ROWS, FOLDS, SUSTAINED = 16_000, 5, 3
CHAIN = ("insult", "sustained", "toxic")


def _odds(rows: list, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per slot: smoothed log odds of presence in toxic and other texts, and their z score."""
    on, off = np.full(SLOTS, 0.5), np.full(SLOTS, 0.5)
    for (slots, _, _), label in zip(rows, y):
        (on if label else off)[slots] += 1
    n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
    odds = np.log(on / (n1 - on + 0.5).clip(0.5)) - np.log(off / (n0 - off + 0.5).clip(0.5))
    return odds, odds / np.sqrt(1 / on + 1 / off)


class Linear:
    """Logistic regression over present words (the KEPT_SLOTS of the greatest z score), a constant
    and earlier logits, by full-batch Adagrad."""

    def __init__(self, kept: np.ndarray, extra: int):
        self.column = np.full(SLOTS, -1, np.int32)
        self.column[kept] = np.arange(len(kept))
        self.w, self.u, self.w0 = np.zeros(len(kept) + 1), np.zeros(extra), 0.0

    def design(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        columns = [self.column[s] for s, _, _ in rows]
        columns = [np.append(c[c >= 0], len(self.w) - 1) for c in columns]
        sizes = np.array([len(c) for c in columns])
        return np.concatenate(columns), np.cumsum(sizes) - sizes

    def logits(self, design: tuple, earlier: np.ndarray) -> np.ndarray:
        return self.w0 + features.sums(self.w[design[0]], design[1]) + earlier @ self.u

    def fit(self, rows: list, y: np.ndarray, earlier: np.ndarray) -> Linear:
        if not len(y) or y.min() == y.max():
            self.w0 = -6.0 if not len(y) or not y[0] else 6.0
            return self
        columns, starts = design = self.design(rows)
        sizes = np.diff(starts, append=len(columns))
        self.w0 = float(np.log(y.mean() / (1 - y.mean())))
        gw, gu, g0 = np.full(len(self.w), 1e-8), np.full(len(self.u), 1e-8), 1e-8
        for _ in range(STEPS):
            e = (1 / (1 + np.exp(-np.clip(self.logits(design, earlier), -30, 30))) - y) / len(y)
            dw = np.bincount(columns, np.repeat(e, sizes), len(self.w)) + DECAY * self.w / 10
            du, d0 = earlier.T @ e + DECAY * self.u, e.sum()
            gw, gu, g0 = gw + dw * dw, gu + du * du, g0 + d0 * d0
            self.w -= RATE * dw / np.sqrt(gw)
            self.u -= RATE * du / np.sqrt(gu)
            self.w0 -= RATE * d0 / np.sqrt(g0)
        return self


class Chain:
    """The fitted models in order, the marker slots, and the threshold of the last."""

    def __init__(self, models: list[Linear], threshold: float):
        self.models, self.threshold = models, threshold

    def probabilities(self, rows: list) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for m in self.models:
            z = np.clip(m.logits(m.design(rows), earlier), -12, 12)
            earlier = np.column_stack([earlier, z])
        return 1 / (1 + np.exp(-earlier))


def fit_chain(rows: list, toxic: np.ndarray) -> Chain:
    """Out-of-fold logits train the later models; the final models see all rows. Word choice and
    markers are made anew within each fold."""
    if not len(toxic):
        return Chain([Linear(np.zeros(0, np.int64), k).fit([], toxic, np.zeros((0, k))) for k in range(len(CHAIN))], 0.5)
    fold = np.arange(len(rows)) % CV
    whole = [np.arange(len(rows)), *[np.flatnonzero(fold != f) for f in range(CV)]]
    chosen, targets = [], []
    for part in whole:
        odds, z = _odds([rows[i] for i in part], toxic[part])
        chosen.append(np.argsort(-np.abs(z), kind="stable")[:KEPT_SLOTS])
        markers = np.zeros(SLOTS, bool)
        markers[(z > 4) & (odds > 3)] = True
        hits = np.array([c[markers[s]].sum() for s, c, _ in rows])
        targets.append([toxic * (hits > 0), toxic * (hits >= SUSTAINED), toxic])
    oof = np.zeros((len(rows), len(CHAIN)))
    models = []
    for k in range(len(CHAIN)):
        for f in range(CV):
            part, test = whole[f + 1], np.flatnonzero(fold == f)
            if len(test):
                m = Linear(chosen[f + 1], k).fit([rows[i] for i in part], targets[f + 1][k][part], oof[part, :k])
                oof[test, k] = np.clip(m.logits(m.design([rows[i] for i in test]), oof[test, :k]), -12, 12)
        models.append(Linear(chosen[0], k).fit(rows, targets[0][k], oof[:, :k]))
    return Chain(models, _best_threshold(1 / (1 + np.exp(-oof[:, -1])), toxic))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F0.5 of the out-of-fold predictions is greatest (a false alarm weighs double), half way
    to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    if not hit[-1]:
        return 0.5
    k = int(np.argmax(hit / (np.arange(1, len(p) + 1) + 0.25 * hit[-1])))
    return float((p[order[k]] + p[order[min(k + 1, len(p) - 1)]]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    return fit_chain(*features.sample_features(features.labelled_sample(docs, labels, "toxic", FOLDS, sample_rows), SLOTS, 4 * sample_rows))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, p_insult, p_sustained, p_toxic, toxic) for every row, by one pass.

    Learns only from rows whose id hash is not held out. Defined results: an empty table gives no
    rows; null and empty texts have no words and the scores of none; an n_chars that is no number counts
    as missing; without labels nothing is toxic;
    rows of equal doc_id are scored each; other columns are ignored."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # a fixed number of slots

    def run(batches):
        chain, words = held.value, features.WordSlots(SLOTS)
        for batch in common.slices(batches, 512):
            rows = [features.features(t, c, words) for t, c in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            p = chain.probabilities(rows)
            columns = [batch.column("doc_id"), *[pa.array(p[:, k]) for k in range(len(CHAIN))], pa.array(p[:, -1] >= chain.threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"p_{c}" for c in CHAIN], "toxic"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", features.char_count(docs).alias("n_chars"))
    scored = given.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", toxic boolean")
    return scored.withColumn("held_out", common.id_bucket(F.col("doc_id"), FOLDS) == 0)
