"""Between the jobs of a search: which vectors to try next, when to stop, and a log to go on from.

Only vectors and objectives are here, one row a trial; the jobs that evaluate them are in `search`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from tickloom.operators.matrix import ResultStore

Space = dict[str, tuple[float, float, float]]
Vector = dict[str, float]
Known = Sequence[tuple[Vector, float]]
#: Random trials before the estimator is asked; drawn candidates per wanted vector.
STARTUP, CANDIDATES = 20, 32
#: Up to this many vectors a space is listed when draws find no new one.
LISTED = 100_000


def sizes(space: Space) -> np.ndarray:
    """Values of each parameter."""
    return np.array([int((high - low) / step + 1e-9) + 1 for low, high, step in space.values()])


def vector(space: Space, index: Sequence[int]) -> Vector:
    return {k: low + step * int(i) for i, (k, (low, _, step)) in zip(index, space.items())}


def index_of(space: Space, v: Vector) -> tuple[int, ...]:
    return tuple(int(round((v[k] - low) / step)) for k, (low, _, step) in space.items())


def startup_trials(space: Space) -> int:
    """More random trials for small spaces, where the estimator would settle too soon."""
    n = float(np.prod(sizes(space).astype(float)))
    if n < 500:
        return max(STARTUP, min(50, int(n // 5)))
    return max(STARTUP, min(30, int(n // 10))) if n < 5000 else STARTUP


def random_batch(space: Space, n: int, rng: np.random.Generator, taken: set[tuple[int, ...]] | None = None) -> list[Vector]:
    """n vectors, none twice and none taken; fewer where the space has no more."""
    counts, used, out = sizes(space), set(taken or ()), []
    for _ in range(20 * n):
        if len(out) == n:
            break
        index = tuple(rng.integers(0, counts).tolist())
        if index not in used:
            used.add(index)
            out.append(index)
    if len(out) < n and float(np.prod(counts.astype(float))) <= LISTED:
        rest = [i for i in np.ndindex(*counts) if i not in used]
        out += [rest[k] for k in rng.permutation(len(rest))[: n - len(out)]]
    return [vector(space, i) for i in out]


def _log_density(at: np.ndarray, centres: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Logarithm of a mixture of normal kernels, one of a uniform among them; coordinates within 0, 1."""
    z = (at[:, None, :] - centres[None, :, :]) / width
    kernels = np.exp(-0.5 * (z**2).sum(axis=2)) / np.prod(width * math.sqrt(2 * math.pi))
    return np.log((kernels.sum(axis=1) + 1.0) / (len(centres) + 1))


def joint_batch(space: Space, n: int, known: Known, rng: np.random.Generator, startup: int | None = None, pending: Sequence[Vector] = ()) -> list[Vector]:
    """Tree-structured Parzen estimator over whole vectors (Bergstra et al. 2011; Falkner et al. 2018):
    kernels with one width a dimension around good trials and around the rest; of vectors drawn near
    good ones, those likeliest under the good against the rest. Each vector of the batch, and each
    pending one, counts as a bad trial for the next (the constant liar), so that a batch spreads. No
    vector comes twice, and none that is known."""
    finite = sorted((x for x in known if math.isfinite(x[1])), key=lambda x: -x[1])
    taken = {index_of(space, v) for v, _ in known} | {index_of(space, v) for v in pending}
    if len(finite) < (startup_trials(space) if startup is None else startup):
        return random_batch(space, n, rng, taken)
    counts = sizes(space)
    span = np.maximum(counts - 1, 1)
    at = np.array([index_of(space, v) for v, _ in finite]) / span
    cut = min(max(3, math.ceil(0.15 * len(finite))), len(finite) - 1)
    good, rest = at[:cut], [*at[cut:], *[np.array(index_of(space, v)) / span for v in pending]]
    least = 0.5 / span

    def width(rows: np.ndarray) -> np.ndarray:
        return np.clip(rows.std(axis=0) * len(rows) ** (-1 / (rows.shape[1] + 4)), np.maximum(least, 0.03), 0.5)

    out = []
    for _ in range(n):
        near = good[rng.integers(0, len(good), CANDIDATES)] + rng.normal(0, 1, (CANDIDATES, len(counts))) * width(good) * 1.5
        draws = np.unique(np.clip(np.rint(np.concatenate([near, rng.random((CANDIDATES // 4, len(counts)))]) * span), 0, counts - 1).astype(int), axis=0)
        draws = np.array([d for d in draws.tolist() if tuple(d) not in taken])
        if not len(draws):
            found = random_batch(space, 1, rng, taken)
            if not found:
                break
            chosen = index_of(space, found[0])
        else:
            bad = np.array(rest)
            score = _log_density(draws / span, good, width(good)) - _log_density(draws / span, bad, width(bad))
            chosen = tuple(draws[int(np.argmax(score))].tolist())
        taken.add(chosen)
        rest.append(np.array(chosen) / span)
        out.append(vector(space, chosen))
    return out


@dataclass(frozen=True)
class Stops:
    """When a search ends before its batches do. Times are in seconds."""

    seconds: float = math.inf
    #: Batches that bring nothing better.
    patience: int | None = None
    #: Time without an improvement after which the search counts as stalled, once it ran min_seconds.
    stall: float = math.inf
    min_seconds: float = 0.0
    #: A stalled search goes on only while less than this share of the space is explored, three stalls
    #: have not passed, and the mean rate of the last improvements is over the floor and over a fifth
    #: of the peak.
    explored: float = 0.3
    floor: float = 0.0
    last: int = 5


def improvements(history: Sequence[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(time, objective, rate) of each trial better than all before; the rate is the gain in percent
    of the best before per second since it, 0 for the first and where that was not positive."""
    out: list[tuple[float, float, float]] = []
    for at, x in history:
        if not math.isfinite(x) or (out and x <= out[-1][1]):
            continue
        rate = 0.0
        if out and out[-1][1] > 0 and at > out[-1][0]:
            rate = (x / out[-1][1] - 1) * 100 / (at - out[-1][0])
        out.append((at, x, rate))
    return out


def stop_reason(stops: Stops, batch_ends: Sequence[float], history: Sequence[tuple[float, float]], space_size: float) -> str | None:
    """Why to stop now: time, patience or stall; None to go on. batch_ends: when each batch ended, the
    last is now; history: (time, objective) of every trial."""
    now = batch_ends[-1] if batch_ends else 0.0
    if now >= stops.seconds:
        return "time"
    better = improvements(history)
    if not better:
        return "patience" if stops.patience is not None and len(batch_ends) >= stops.patience else None
    since = better[-1][0]
    if stops.patience is not None and sum(t > since for t in batch_ends) >= stops.patience:
        return "patience"
    if now < stops.min_seconds or now - since < stops.stall:
        return None
    rates = [r for _, _, r in better[1:]]
    if len(history) / max(space_size, 1.0) >= stops.explored:
        return "stall: the space is explored"
    if now - since >= 3 * stops.stall:
        return "stall: nothing better for three stalls"
    if not rates or np.mean(rates[-stops.last :]) < max(stops.floor, 0.2 * max(rates)):
        return "stall: improvements have become slow"
    return None


class TrialLog:
    """The trials of a search in a folder, a run a batch, from which a killed search goes on. A batch
    is there as a whole or not at all."""

    SCHEMA = "batch int, trial int, seconds double, params string, objective double"

    def __init__(self, spark: SparkSession, path: str):
        self.store = ResultStore(spark, path, self.SCHEMA, ["batch", "trial"])

    def append(self, batch: int, first: int, seconds: float, vectors: Sequence[Vector], objectives: Sequence[float]) -> None:
        rows = [(batch, first + k, seconds, json.dumps(v, sort_keys=True), x) for k, (v, x) in enumerate(zip(vectors, objectives))]
        self.store.append(self.store.spark.createDataFrame(rows, self.SCHEMA).coalesce(1))

    def trials(self) -> list[tuple[int, float, Vector, float]]:
        """(batch, seconds, vector, objective) in order: a row a trial, as the search holds them too."""
        rows = self.store.rows().collect()
        return [(r["batch"], r["seconds"], json.loads(r["params"]), r["objective"]) for r in sorted(rows, key=lambda r: (r["batch"], r["trial"]))]
