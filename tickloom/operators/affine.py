"""Recursions that are affine in their state, over NumPy arrays: run from a state, summed up as a map
of the state, and passed on. What one chunk of a series does to the state is a few numbers, so that
chunks are summed up side by side, the sums are passed on in time order, and each chunk is finished
with the state that enters it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def affine(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """y[i] = a[i] * y[i - 1] + b[i] from start. Blocks of about the root of the length go side by
    side: their maps first, then the states between them, then their values."""
    n = len(a)
    if not n:
        return np.zeros(0)
    steps = max(1, math.isqrt(n))
    blocks = -(-n // steps)
    pad = steps * blocks - n
    a = np.ascontiguousarray(np.concatenate([a, np.ones(pad)]).reshape(blocks, steps).T)
    b = np.ascontiguousarray(np.concatenate([b, np.zeros(pad)]).reshape(blocks, steps).T)
    fade, offset = np.ones(blocks), np.zeros(blocks)
    for k in range(steps):
        fade, offset = a[k] * fade, a[k] * offset + b[k]
    y, enter = start, np.empty(blocks)
    for j, (f, o) in enumerate(zip(fade.tolist(), offset.tolist())):
        enter[j] = y
        y = f * y + o
    out = np.empty((steps, blocks))
    for k in range(steps):
        enter = a[k] * enter + b[k]
        out[k] = enter
    return out.T.ravel()[:n]


def _end(a: np.ndarray, b: np.ndarray, start: float) -> float:
    return float(affine(a, b, start)[-1]) if len(a) else start


@dataclass(frozen=True)
class Mean:
    """Exponential mean seeded by the first value. A gap lets the old mean fade: its weight shrinks by
    1 - alpha with each row. Missing until n values were seen; later gaps carry the mean on. The
    state is (mean, weight, values seen)."""

    alpha: float
    n: int
    start = (0.0, 0.0, 0.0)

    def _maps(self, x: np.ndarray, weight: float, seen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, at = ~np.isnan(x), np.arange(len(x))
        last = np.maximum.accumulate(np.where(known, at, -1))
        before = np.concatenate([[-1], last[:-1]])
        old = np.where(before >= 0, 1.0, weight) * (1 - self.alpha) ** (at - before)
        a = np.where(known, old / (old + self.alpha), 1.0)
        b = np.where(known, self.alpha * np.nan_to_num(x) / (old + self.alpha), 0.0)
        if not seen and known.any():
            k = int(np.argmax(known))
            a[k], b[k] = 0.0, x[k]
        return a, b, last

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        mean, weight, seen = state
        a, b, _ = self._maps(x, weight, seen)
        return np.where(seen + np.cumsum(~np.isnan(x)) >= self.n, affine(a, b, mean), np.nan)

    def sum_up(self, x: np.ndarray) -> list[float]:
        """(rows, rows before the first value, it, fade and offset of the values after it, rows after
        the last value, values)."""
        known = ~np.isnan(x)
        if not known.any():
            return [len(x), 0, 0, 1, 0, 0, 0]
        lead = int(np.argmax(known))
        a, b, last = self._maps(x[lead:], 0.0, 0.0)
        return [len(x), lead, x[lead], float(np.prod(a[1:])), _end(a[1:], b[1:], 0.0), len(x) - lead - 1 - int(last[-1]), int(known.sum())]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        mean, weight, seen = state
        rows, lead, first, fade, offset, trail, values = s
        if not values:
            return mean, weight * (1 - self.alpha) ** rows, seen
        old = weight * (1 - self.alpha) ** (lead + 1)
        mean = (old * mean + self.alpha * first) / (old + self.alpha) if seen else first
        return fade * mean + offset, (1 - self.alpha) ** trail, seen + values


@dataclass(frozen=True)
class Follow:
    """A mean that moves by a gain towards each value, from the first value with a gain on; a missing
    value or gain leaves it where it is. x holds values and gains in two rows; the state is (mean,
    whether there is one)."""

    start = (0.0, 0.0)

    def _maps(self, x: np.ndarray, seen: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, gain = x
        sound = ~np.isnan(value + gain)
        a, b = np.where(sound, 1 - gain, 1.0), np.where(sound, gain * value, 0.0)
        if not seen and sound.any():
            k = int(np.argmax(sound))
            a[k], b[k] = 0.0, value[k]
        return a, b, sound

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        a, b, sound = self._maps(x, state[1])
        return np.where(state[1] + np.cumsum(sound) > 0, affine(a, b, state[0]), np.nan)

    def sum_up(self, x: np.ndarray) -> list[float]:
        """(fade, offset, mean if none entered, values)."""
        a, b, sound = self._maps(x, 1.0)
        return [float(np.prod(a)), _end(a, b, 0.0), _end(*self._maps(x, 0.0)[:2], 0.0), int(sound.sum())]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        fade, offset, alone, values = s
        return (fade * state[0] + offset if state[1] else alone), min(1.0, state[1] + values)


@dataclass(frozen=True)
class Filters:
    """Four chained filters that start at zero; gives the share of the falls from each to the next, 0
    to 1. A missing value leaves them where they are. The state is the four filters."""

    gain: float = 0.5
    start = (0.0, 0.0, 0.0, 0.0)

    def _stages(self, x: np.ndarray, state: tuple) -> list[np.ndarray]:
        a, out = np.full(len(x), self.gain), [affine(np.full(len(x), self.gain), (1 - self.gain) * x, state[0])]
        for k in range(1, 4):
            above = np.concatenate([[state[k - 1]], out[-1]])
            out.append(affine(a, above[:-1] - self.gain * above[1:], state[k]))
        return out

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        known = ~np.isnan(x)
        stages = np.array([np.concatenate([[s], v]) for s, v in zip(state, self._stages(x[known], state))])
        falls = (stages[:-1] - stages[1:])[:, np.cumsum(known)]
        total = np.abs(falls).sum(axis=0)
        return np.where(total > 0, np.maximum(falls, 0).sum(axis=0) / np.where(total > 0, total, 1.0), 0.0)

    def sum_up(self, x: np.ndarray) -> list[float]:
        """(values, the filters after them from zero)."""
        known = x[~np.isnan(x)]
        return [len(known), *[float(v[-1]) if len(known) else 0.0 for v in self._stages(known, self.start)]]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        one = np.array([[float(v[-1]) for v in self._stages(np.zeros(1), tuple(e))] for e in np.eye(4)]).T
        return tuple((np.linalg.matrix_power(one, int(s[0])) @ np.array(state) + np.array(s[1:])).tolist())


@dataclass(frozen=True)
class Decay:
    """y = rate * y + x from zero; a missing value counts as zero. The state is y."""

    rate: float
    start = (0.0,)

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        return affine(np.full(len(x), self.rate), np.nan_to_num(x), state[0])

    def sum_up(self, x: np.ndarray) -> list[float]:
        return [self.rate ** len(x), _end(np.full(len(x), self.rate), np.nan_to_num(x), 0.0)]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        return (s[0] * state[0] + s[1],)


@dataclass(frozen=True)
class Clamp:
    """y = pull * x + keep * y, held within -most and most; a missing value counts as zero. Maps that
    are affine between two bounds compose to such a map. The state is y."""

    pull: float
    keep: float
    most: float
    start = (0.0,)

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        y, out = state[0], np.empty(len(x))
        for i, v in enumerate(np.nan_to_num(x).tolist()):
            y = max(-self.most, min(self.most, self.pull * v + self.keep * y))
            out[i] = y
        return out

    def sum_up(self, x: np.ndarray) -> list[float]:
        """(factor, offset, lower bound, upper bound)."""
        a, b, low, high = 1.0, 0.0, -math.inf, math.inf
        for v in np.nan_to_num(x).tolist():
            a, b = self.keep * a, self.pull * v + self.keep * b
            low, high = (max(-self.most, min(self.most, self.pull * v + self.keep * t)) for t in (low, high))
        return [a, b, low, high]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        return (max(s[2], min(s[3], s[0] * state[0] + s[1])),)


@dataclass(frozen=True)
class Cooldown:
    """1 where an edge (a value over zero) is accepted: the last accepted one is `bars` or more behind.
    The state is how many rows are still to wait; a chunk is summed up as a table from each such number
    to the one it leaves."""

    bars: int
    start = (0.0,)

    def _walk(self, edges: list[int], n: int, wait: int) -> tuple[list[int], int]:
        free, taken = wait, []
        for i in edges:
            if i >= free:
                taken.append(i)
                free = i + self.bars
        return taken, max(0, free - n)

    def run(self, x: np.ndarray, state: tuple) -> np.ndarray:
        out = np.zeros(len(x))
        out[self._walk(np.flatnonzero(np.nan_to_num(x) > 0).tolist(), len(x), int(state[0]))[0]] = 1.0
        return out

    def sum_up(self, x: np.ndarray) -> list[float]:
        edges = np.flatnonzero(np.nan_to_num(x) > 0).tolist()
        return [float(self._walk(edges, len(x), wait)[1]) for wait in range(max(1, self.bars))]

    def pass_on(self, state: tuple, s: list[float]) -> tuple:
        return (s[int(state[0])],)
