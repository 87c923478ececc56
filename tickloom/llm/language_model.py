"""Language-model scores by online logistic context mixing, next to an add-one unigram base.

Every token (a word, or the end of its text) is coded by binary decisions:

1. Is it the token that most often followed its two predecessors in the training texts?
2. If not: is it the one that followed them at their last earlier place in the same text?
3. If neither: BITS decisions give its class (a hash of its last two bytes), and its share of the
   class's training tokens the rest.

The chance of a token is the sum over the ways to reach it, so that all chances add up to one. Each
decision is predicted from several hashed contexts (the two predecessors; the text so far; the
class before; the last short word; none), whose stretched predictions are mixed by weights that a
gate selects (how long the guesses have held; depth and the length of the text so far), and then
refined by an adaptive probability map.

Texts are dealt into chunks by a hash of the row, never by the split of the table, training and
held-out texts apart. A chunk sends its distinct tokens and (context, token) keys to shards, which
add them up over the corpus and answer each chunk. Then every chunk of training texts learns
weights and map online, in the order of doc_id, and the means over all training tokens are the
model; at last every chunk is scored. Where a training text is learnt from or scored, each place's
own occurrence is taken out of the context counts first, so that a text does not predict itself.

Keys have 64 bits; their share of the context grows with the corpus, and what is left tells the
tokens behind it apart. Other tokens of the vocabulary may share that rest, so the chance of a
guess is divided by their expected number. Counts of tokens and contexts grow with the corpus and
stay sharded; class tables, weights and map have fixed sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, hashing
from tickloom.llm.packed import merge, pack, pack_sorted, shard_runs, table, unpack, unpack_sorted

BITS = 10
CLASSES = 1 << BITS
#: Path inputs: no context, class before, last short word, text so far, constant. Guess inputs:
#: share of the guess, how long it held, whether the other guess exists, constant.
INPUTS, GUESS_INPUTS = 5, 4
#: Gates of the path (lengths of the text so far, by depth) and of a guess (runs of hits).
AGES, RUNS, BUCKETS = 4, 8, 33
GATES = AGES * BITS
#: States of a context: sizes by shares of the most frequent follower; 0 is an unknown context.
SIZES, SHARES = 8, 6
STATES = 1 + SIZES * SHARES
BLOCK, BATCH, RATE, PRIOR = 64, 4096, 0.02, 2.0
#: Words of so many bytes at most are short.
SHORT = 3
#: Tokens whose inputs are held at a time; a multiple of BLOCK.
SPAN = 1 << 15
CHUNK_BYTES, SHARD_BYTES, FOLDS, HELD_OUT = 6 << 20, 32 << 20, 7, 2
#: Class tables are added in parts, so many chunks at a time.
_PARTS, FAN = 8, 64
_UNITS = 1 << 10
_END = 1 << 17
_LOW = np.uint64(CLASSES - 1)
ASK_SCHEMA = "shard int, chunk long, training boolean, keys binary, counts binary"
ANSWER_SCHEMA = "chunk long, shard int, answer binary, sums binary"
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def ending_class(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Class of words by their last two bytes (before: 256 where there is one byte only)."""
    return (hashing.mix((last + 257 * before + 1).astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


#: Bytes of text whose words are hashed at a time (a longer text is one step).
HASH_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(2_024).integers(0, 1 << 64, 256, np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = {f: np.ones(1, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))}
_END_HASH = np.uint64(0x5851F42D4C957F2D)


def _powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0, 1, ..., n - 1 in 64 bits."""
    if len(_POWERS[factor]) < n:
        steps = np.full(max(n, HASH_BYTES + HASH_BYTES // 8), factor, np.uint64)
        steps[0] = 1
        _POWERS[factor] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[factor][:n]


def word_table(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, classes, lengths) of the words of some texts in one run, and how many each text has.
    A word's hash is a polynomial of random numbers for its bytes, from prefix sums, then mixed."""
    raw = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    space = _SPACE.take(raw)
    begin, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:])
    sums = np.cumsum(_BYTES.take(raw) * _powers(_FACTOR, len(raw)), dtype=np.uint64)
    length = end - begin + 1
    hashes = (sums[end] - sums[begin - 1]) * _powers(pow(_FACTOR, -1, 1 << 64), len(raw))[begin]
    hashes = hashing.mix(hashes + length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    classes = ending_class(raw[end].astype(np.int64), np.where(length > 1, raw[end - 1].astype(np.int64), 256))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, classes, length, np.diff(np.searchsorted(begin, np.append(0, ends) + 1))


class Tokens:
    """The tokens of a run of texts: hashes (the class in the lowest bits), classes and contexts."""

    def __init__(self, texts: list):
        parts, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append((text or "").encode("utf-8", "surrogatepass").lower())
            size += len(held[-1]) + 1
            if size >= HASH_BYTES or k == len(texts) - 1:
                parts.append(word_table(held))
                held, size = [], 0
        hashes, classes, lengths, counts = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.sizes = counts + 1
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        n = int(self.sizes.sum())
        self.at = np.arange(n) - np.repeat(self.starts, self.sizes)
        word = np.ones(n, bool)
        word[self.ends - 1] = False
        self.code = np.full(n, int(ending_class(np.array([_END]), np.array([0]))[0]))
        self.code[word] = classes
        self.hash = np.full(n, _END_HASH, np.uint64)
        self.hash[word] = hashes
        self.hash = (self.hash & ~_LOW) | self.code.astype(np.uint64)
        self.short = np.zeros(n, bool)
        self.short[word] = lengths <= SHORT

    def back(self, n: int) -> np.ndarray:
        """Hash of the token n places before; that of the end before a text."""
        out = np.full(len(self.hash), self.hash[self.ends[0] - 1] if len(self.hash) else 0, np.uint64)
        out[n:] = self.hash[:-n]
        out[self.at < n] = self.hash[self.ends[0] - 1] if len(self.hash) else 0
        return out

    def pair_context(self) -> np.ndarray:
        return hashing.mix(self.back(1) * np.uint64(3) ^ hashing.mix(self.back(2)))

    def keys(self, context_bits: int) -> np.ndarray:
        """The two predecessors' hash in the upper bits, then the token's."""
        rest = np.uint64(64 - context_bits)
        return (self.pair_context() >> rest << rest) | (hashing.mix(self.hash) >> np.uint64(context_bits))

    def class_contexts(self) -> np.ndarray:
        """(2, tokens): the class before, and a class of the last short word."""
        before = (self.back(1) & _LOW).astype(np.int64)
        seen = np.maximum.accumulate(np.append(-1, np.where(self.short, np.arange(len(self.hash)), -1)))[:-1]
        word = (hashing.mix(self.hash[np.maximum(seen, 0)]) >> np.uint64(64 - BITS)).astype(np.int64) if len(seen) else seen
        return np.stack([before, np.where(seen >= np.repeat(self.starts, self.sizes), word, 0)])

    def repeat(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the two predecessors stood together before in the text, and whether the token
        that followed them at the last such place is this one."""
        places = np.uint64(max(1, len(self.hash).bit_length()))
        key = hashing.mix(self.pair_context() + self.doc.astype(np.uint64)) << places | np.arange(len(self.hash), dtype=np.uint64)
        key.sort()
        order = (key & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
        same = np.flatnonzero(key[1:] >> places == key[:-1] >> places)
        found, hit = np.zeros(len(order), bool), np.zeros(len(order), bool)
        found[order[same + 1]] = True
        hit[order[same + 1]] = self.hash[order[same + 1]] == self.hash[order[same]]
        return found, hit

    def runs(self, found: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """How long a guess has held before each token, on a scale of RUNS: 0 where the last guess
        failed, the last level where there was none since the start."""
        at = np.arange(len(hit))
        start = np.repeat(self.starts, self.sizes)

        def last(mask):
            return np.maximum(np.append(-1, np.maximum.accumulate(np.where(mask, at, -1))[:-1])[: len(at)], start - 1)

        right = np.append(0, np.cumsum(hit))
        count = right[at] - right[last(found & ~hit) + 1]
        scale = np.append(np.ceil(np.log2(np.arange(1, 1 << (RUNS - 2)))), RUNS - 2).astype(np.int64)
        return np.where(last(found) < start, RUNS - 1, scale.take(np.minimum(count, len(scale) - 1)))


def context_bits(size: int) -> int:
    """Bits of a context in a key: three more than a text of that size can have bytes, 44 at most."""
    return min(44, max(24, size.bit_length() + 3))


def states(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    """State of a context from the count of its most frequent follower and of all (0: unknown)."""
    size = np.searchsorted([2, 3, 4, 6, 9, 17, 33], total, side="right")
    share = np.where(best == total, SHARES - 1, (SHARES - 1) * best // np.maximum(total, 1))
    return np.where(total > 0, 1 + size * SHARES + share, 0)


class Followers:
    """Of sorted (context, token) keys with counts: each context's total and two best followers."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int):
        self.keys, self.counts, self.rest = keys, counts, np.uint64(64 - bits)
        of = keys >> self.rest
        self.first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = of[self.first]
        self.run = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(keys))))
        if not len(keys):
            return
        self.total = np.add.reduceat(counts, self.first)
        self.best, self.top = self._best(counts)
        others = counts.copy()
        others[self.best] = 0
        self.second, self.next = self._best(others)

    def _best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of the most frequent follower of each context, the first of equals."""
        top = np.maximum.reduceat(counts, self.first)
        return np.minimum.reduceat(np.where(counts == top[self.run], np.arange(len(counts)), len(counts)), self.first), top

    def answer(self, asked: np.ndarray, training: bool) -> np.ndarray:
        """A byte for each key: twice the state of its context, plus one if its token is the guess.
        For training texts, one occurrence of the key itself is left out."""
        out = np.zeros(len(asked), np.uint8)
        if not len(self.keys):
            return out
        run = np.minimum(np.searchsorted(self.contexts, asked >> self.rest), len(self.contexts) - 1)
        at = np.flatnonzero(self.contexts[run] == asked >> self.rest)
        run, asked = run[at], asked[at]
        best, total, hit = self.top[run], self.total[run], self.keys[self.best[run]] == asked
        if training:
            total = total - 1
            own, second, other = best - 1, self.next[run], self.keys[self.second[run]]
            stays = (own > second) | ((own == second) & (asked < other))
            best = np.where(hit, np.maximum(own, second), best)
            hit &= stays
        out[at] = np.where(total > 0, 2 * states(best, total) + hit, 0)
        return out


def heap(leaves: np.ndarray) -> np.ndarray:
    """Counts at all nodes of the class tree, leaves last: node k's children are 2k and 2k + 1."""
    out = np.zeros((*leaves.shape[:-1], 2 * CLASSES), np.float32)
    out[..., CLASSES:] = leaves
    for depth in range(BITS - 1, -1, -1):
        a, b = 1 << depth, 2 << depth
        out[..., a:b] = out[..., 2 * a : 2 * b : 2] + out[..., 2 * a + 1 : 2 * b : 2]
    return out


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(np.maximum(-z, -16), 16)))


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.rint(np.minimum(np.maximum(z, -8), 8) * 2 + BUCKETS // 2).astype(np.int64)


class Tables:
    """Class counts of the corpus: without context, and behind the two class contexts."""

    def __init__(self, leaves: np.ndarray):
        self.leaves, self._nodes = leaves, None

    def __getstate__(self):
        return (self.leaves, None)

    def __setstate__(self, state):
        self.leaves, self._nodes = state

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(zeros, ones) of each node behind both contexts, as pairs, the chance of a one at each
        node without context, and its log odds."""
        if self._nodes is None:
            counts = heap(self.leaves)
            every = counts[0].sum(axis=0, dtype=np.float64)
            one = np.append(0.5, (every[3::2] + 0.5) / (every[2::2] + every[3::2] + 1))
            self._nodes = _pairs(counts.reshape(2, -1)), one.astype(np.float32), stretch(one).astype(np.float32)
        return self._nodes


def _pairs(counts: np.ndarray) -> np.ndarray:
    """Neighbouring pairs of 32-bit numbers as one item each, so that one look-up brings both."""
    return np.ascontiguousarray(counts).view(np.float64)


class Mixer:
    """Weights and adaptive map, in one vector to add up: weights times tokens learnt from, counts
    of zeros and ones of each map cell, and the tokens learnt from."""

    SHAPES = ((GATES, INPUTS), (2 * RUNS, GUESS_INPUTS))
    #: Map cells: of the path, by gate and bucket; of a guess, by run and state.
    PATH_CELLS, CELLS = GATES * BUCKETS, GATES * BUCKETS + 2 * RUNS * STATES
    LENGTH = GATES * INPUTS + 2 * RUNS * GUESS_INPUTS + 2 * CELLS + 1

    def __init__(self):
        self.path = np.full(self.SHAPES[0], 0.4, np.float32)
        self.path[:, 4] = 0
        self.guess = np.tile(np.array([1, 0.1, 0, 0], np.float32), (2 * RUNS, 1))
        self.map = np.zeros((self.CELLS, 2), np.int64)
        self.learnt = 0

    def vector(self) -> np.ndarray:
        weights = np.concatenate([self.path.ravel(), self.guess.ravel()]).astype(np.float64)
        return np.concatenate([np.rint(weights * self.learnt * _UNITS).astype(np.int64), self.map.ravel(), [self.learnt]])

    @classmethod
    def of(cls, vector: np.ndarray) -> Mixer:
        out, n, size = cls(), int(vector[-1]), GATES * INPUTS
        if n:
            weights = (vector[: size + 2 * RUNS * GUESS_INPUTS] / (n * _UNITS)).astype(np.float32)
            out.path, out.guess = weights[:size].reshape(cls.SHAPES[0]), weights[size:].reshape(cls.SHAPES[1])
        out.map = vector[size + 2 * RUNS * GUESS_INPUTS : -1].reshape(cls.CELLS, 2)
        out.learnt = n
        return out

    def chances(self) -> np.ndarray:
        """Chance of a one in each map cell."""
        middle = np.tile(squash((np.arange(BUCKETS) - BUCKETS // 2) / 2), GATES)
        first = np.concatenate([middle, np.tile(squash(state_odds()), 2 * RUNS)])
        return ((self.map[:, 1] + 8 * first) / (self.map.sum(axis=1) + 8)).astype(np.float32)


def state_odds() -> np.ndarray:
    """Log odds of a hit in each state, before anything is learnt."""
    out = np.full(STATES, -1.0)
    for size, n in enumerate((1, 2, 3, 5, 7, 12, 24, 64)):
        share = np.array([0.1, 0.3, 0.5, 0.7, 0.9, 1.0])
        out[1 + size * SHARES : 1 + (size + 1) * SHARES] = stretch((n * share + 0.3) / (n + 1))
    return out


class Decisions:
    """The decisions of a chunk's tokens. answers: the byte of each token's (context, token) key."""

    def __init__(self, tokens: Tokens, answers: np.ndarray, tables: Tables, training: bool):
        self.tokens, self.tables, self.training = tokens, tables, training
        self.contexts = tokens.class_contexts()
        found, hit = tokens.repeat()
        self.hits = np.stack([(answers & 1).astype(bool), hit])
        self.states = np.stack([(answers >> 1).astype(np.int64), found.astype(np.int64)])
        self.runs = np.stack([tokens.runs(s > 0, h) for s, h in zip(self.states, self.hits)])
        self._tail: tuple[int, np.ndarray] = (-1, np.zeros(CLASSES, np.float32))

    def guesses(self, k: int, span: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, gates and map cells of the k-th guess."""
        state, run = self.states[k, span], self.runs[k, span]
        x = np.empty((GUESS_INPUTS, len(state)), np.float32)
        x[0] = state_odds().astype(np.float32)[state] if k == 0 else 0.5
        x[1] = np.where(run == RUNS - 1, 0, run)
        x[2] = self.states[1 - k, span] > 0
        x[3] = 0.3
        return x, run + RUNS * k, Mixer.PATH_CELLS + (run + RUNS * k) * STATES + state

    def spans(self) -> Iterator[slice]:
        """The tokens in runs of whole texts, or of blocks of one long text, in order."""
        a, n = 0, len(self.tokens.hash)
        while a < n:
            doc = self.tokens.doc[a]
            b = int(self.tokens.ends[np.searchsorted(self.tokens.ends, a + SPAN, side="right") - 1]) if self.tokens.ends[doc] <= a + SPAN else a + SPAN
            yield slice(a, b)
            a = b

    def _text_so_far(self, span: slice) -> tuple[np.ndarray, np.ndarray]:
        """(zeros, ones) at the nodes of each text's earlier blocks, and each token's row among them."""
        t, a, b = self.tokens, span.start, span.stop
        block = (t.at[a:b] // BLOCK) + t.doc[a:b] * (1 << 40)
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
        counts = np.bincount(row * CLASSES + t.code[a:b], minlength=len(first) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
        before, doc = np.empty_like(counts), t.doc[a + first].tolist()
        last, so_far = self._tail
        for k, (d, own) in enumerate(zip(doc, counts)):
            if d != last:
                last, so_far = d, np.zeros(CLASSES, np.float32)
            before[k] = so_far
            so_far = so_far + own
        self._tail = (last, so_far)
        return _pairs(heap(before).ravel()), row

    def path(self, span: slice, use: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth: (INPUTS, tokens) stretched predictions, gates and decisions of the tokens
        of the span that `use` names."""
        corpus, one, odds = self.tables.nodes()
        seen, row = self._text_so_far(span)
        code = self.tokens.code[span][use]
        sources = [(corpus[k], self.contexts[k, span][use] * CLASSES, self.training) for k in range(2)] + [(seen, row[use] * CLASSES, False)]
        age = np.searchsorted([1, 4, 16], self.tokens.at[span][use] // BLOCK, side="right")
        for depth in range(BITS):
            node = (1 << depth) | (code >> (BITS - depth))
            bit = (code >> (BITS - 1 - depth)) & 1
            x = np.empty((INPUTS, len(code)), np.float32)
            chance = one.take(node)
            ones, zeros = np.float32(PRIOR) * chance, np.float32(PRIOR) * (1 - chance)
            x[0] = odds.take(node)
            for k, (counts, at, training) in enumerate(sources):
                pair = counts.take(at + node).view(np.float32).reshape(-1, 2)
                own = bit.astype(np.float32) if training else np.float32(0)
                x[1 + k] = np.log((pair[:, 1] + ones - own) / (pair[:, 0] + zeros - ((1 - own) if training else own)))
            x[4] = 0.3
            yield x, depth + BITS * age, bit


def _step(mixer: Mixer, weights: np.ndarray, x: np.ndarray, gates: np.ndarray, hit: np.ndarray, cells: np.ndarray | None) -> None:
    """Online steps of BATCH decisions each: weights and map move. cells: None for the path."""
    low, high = int(gates.min()), int(gates.max()) + 1
    z = np.empty(x.shape[1], np.float32)
    for a in range(0, x.shape[1], BATCH):
        part, gate, y = x[:, a : a + BATCH], gates[a : a + BATCH], hit[a : a + BATCH]
        now = _mixed(weights, part, gate)
        z[a : a + BATCH] = now
        e = (y - squash(now)).astype(np.float32)
        scale = RATE / (1 + np.sqrt(np.bincount(gate - low, minlength=high - low)))
        for k in range(len(x)):
            weights[low:high, k] += scale * np.bincount(gate - low, e * part[k], high - low)
    at = gates * BUCKETS + _bucket(z) if cells is None else cells
    mixer.map += np.bincount(at * 2 + hit, minlength=2 * Mixer.CELLS).reshape(-1, 2)


def learn(mixer: Mixer, decisions: Decisions) -> None:
    """One pass over the decisions in the order of the texts; the path only where no guess hit."""
    hits, found = decisions.hits, decisions.states > 0
    for span in decisions.spans():
        left = np.ones(span.stop - span.start, bool)
        for k in range(2):
            use = np.flatnonzero(found[k, span] & left)
            if len(use):
                x, gates, cells = decisions.guesses(k, span)
                _step(mixer, mixer.guess, x[:, use], gates[use], hits[k, span][use].astype(np.int64), cells[use])
            left &= ~hits[k, span]
        for x, gates, bit in decisions.path(span, np.flatnonzero(left)):
            if len(bit):
                _step(mixer, mixer.path, x, gates, bit, None)
        mixer.learnt += span.stop - span.start


def _mixed(weights: np.ndarray, x: np.ndarray, gates: np.ndarray) -> np.ndarray:
    z = x[0] * weights[:, 0].take(gates)
    for k in range(1, len(x)):
        z += x[k] * weights[:, k].take(gates)
    return z


def _refined(weights: np.ndarray, cells: np.ndarray, x: np.ndarray, gates: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    """Chance of a one: the mean of the mixed prediction and its map cell."""
    z = _mixed(weights, x, gates)
    return (squash(z) + cells.take(gates * BUCKETS + _bucket(z) if at is None else at)) / 2


def chances(mixer: Mixer, decisions: Decisions, share: np.ndarray, crowd: float) -> np.ndarray:
    """log10 probability of each token. share: of its class; crowd: tokens of the vocabulary that
    share a key's rest, itself included."""
    out, cells = np.empty(len(share)), mixer.chances()
    for span in decisions.spans():
        total = share[span].copy()
        for x, gates, bit in decisions.path(span, np.arange(span.stop - span.start)):
            p = _refined(mixer.path, cells, x, gates, None)
            total *= np.where(bit == 1, p, 1 - p)
        for k in (1, 0):
            p = np.where(decisions.states[k, span] > 0, _refined(mixer.guess, cells, *decisions.guesses(k, span)), 0).astype(np.float64)
            total = (1 - p) * total + np.where(decisions.hits[k, span], p / (crowd if k == 0 else 1), 0)
        out[span] = np.log10(total)
    return out


def _in_order(docs: pa.Table) -> pa.Table:
    """A chunk's rows in an order that the split of the table does not change."""
    rows = docs.column("doc_id").to_pylist()
    texts = docs.column("text").to_pylist()
    order = sorted(range(len(rows)), key=lambda k: (rows[k] is not None, rows[k] or 0, texts[k] is not None, texts[k] or ""))
    return docs.take(pa.array(order, pa.int64()))


def _ask(docs: pa.Table, chunks: int, shards: int, bits: int, fan: int = FAN) -> pa.Table:
    """A chunk's distinct tokens (shards 0 and on) and keys (from `shards` on), with their counts in
    training texts, and its class tables by parts (from 2 * shards on)."""
    chunk = docs.column("chunk")[0].as_py()
    training = chunk < chunks
    tokens = Tokens(docs.column("text").to_pylist())
    rows = []
    for first, every in ((0, tokens.hash), (shards, tokens.keys(bits))):
        keys, counts = np.unique(every, return_counts=True)
        rows += [[first + s, chunk, training, pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint32)) if training else None] for s, a, b in shard_runs(keys, shards)]
    if training:
        groups = 1 + (chunks - 1) // fan
        for k, context in enumerate(tokens.class_contexts()):
            cells, counts = np.unique((context * CLASSES + tokens.code).astype(np.uint64), return_counts=True)
            bounds = np.searchsorted(cells, np.arange(_PARTS + 1, dtype=np.uint64) * np.uint64(CLASSES * CLASSES // _PARTS))
            for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if a < b:
                    rows.append([2 * shards + (k * _PARTS + part) * groups + chunk // fan, chunk, True, pack_sorted(cells[a:b]), pack(counts[a:b].astype(np.uint32))])
    return table(rows, ASK_SCHEMA)


def _answer(asked: pa.Table, shards: int, bits: int) -> pa.Table:
    """One shard: counts over the corpus, and each chunk's answers: counts of its tokens, states of
    its keys; with those of tokens, sums: training tokens and vocabulary of each class, then how
    many tokens and how many different ones. A group of class tables is only added up."""
    shard = asked.column("shard")[0].as_py()
    chunks, training = asked.column("chunk").to_pylist(), asked.column("training").to_pylist()
    keys = [unpack_sorted(x, np.uint64) for x in asked.column("keys").to_pylist()]
    known, counts = merge([k for k, t in zip(keys, training) if t], [unpack(x, np.uint32) for x, t in zip(asked.column("counts").to_pylist(), training) if t])
    if shard >= 2 * shards:
        return table([[-1, shard, pack_sorted(known), pack(counts)]], ANSWER_SCHEMA)
    out = []
    if shard >= shards:
        followers = Followers(known, counts, bits)
        for chunk, asked_keys, t in zip(chunks, keys, training):
            out.append([chunk, shard, pack(followers.answer(asked_keys, t)), None])
        return table(out, ANSWER_SCHEMA)
    mass = np.bincount((known & _LOW).astype(np.int64), counts + 1.0, CLASSES).astype(np.int64)
    out.append([-1, shard, None, pack(np.append(mass, [int(counts.sum()), len(known)]))])
    known, counts = np.append(known, np.uint64(0)), np.append(counts, 0)
    for chunk, asked_keys in zip(chunks, keys):
        at = np.searchsorted(known[:-1], asked_keys)
        out.append([chunk, shard, pack(np.where((known[at] == asked_keys) & (at < len(known) - 1), counts[at], 0)), None])
    return table(out, ANSWER_SCHEMA)


def _answered(every: np.ndarray, answers: pa.Table, first: int, shards: int, kind) -> np.ndarray:
    """What the shards from `first` on answered to a chunk's tokens (counts) or keys (bytes)."""
    of = dict(zip(answers.column("shard").to_pylist(), answers.column("answer").to_pylist()))
    keys, place = np.unique(every, return_inverse=True)
    values = [unpack(of[first + s], kind) for s, _, _ in shard_runs(keys, shards)]
    return np.concatenate([np.zeros(0, kind), *values])[place]


def _learn(docs: pa.Table, answers: pa.Table, tables: Tables, shards: int, bits: int) -> pa.Table:
    """One chunk of training texts: its learnt vector, packed."""
    if not docs.num_rows:
        return table([], "at long, sums binary")
    mixer, tokens = Mixer(), Tokens(_in_order(docs).column("text").to_pylist())
    learn(mixer, Decisions(tokens, _answered(tokens.keys(bits), answers, shards, shards, np.uint8), tables, True))
    return table([[docs.column("chunk")[0].as_py(), pack(mixer.vector())]], "at long, sums binary")


def _score(docs: pa.Table, answers: pa.Table, model: tuple, chunks: int, shards: int, bits: int) -> pa.Table:
    if not docs.num_rows:
        return table([], SCORE_SCHEMA)
    docs = _in_order(docs)
    mixer, tables, mass, n, v = model
    held = docs.column("chunk")[0].as_py() >= chunks
    texts = docs.column("text").to_pylist()
    tokens = Tokens(texts)
    c = _answered(tokens.hash, answers, 0, shards, np.int64)
    guessed = _answered(tokens.keys(bits), answers, shards, shards, np.uint8)
    ours = np.log10(c + 1)
    base = ours - math.log10(n + v + 1)
    crowd = 1 + v / 2.0 ** (64 - bits)
    score = chances(mixer, Decisions(tokens, guessed, tables, not held), (c + 1) / (mass[tokens.code] + 1), crowd)  # one unknown token a class
    sums = [np.add.reduceat(x, tokens.starts).tolist() for x in ((c > 0).astype(np.int64), base, score)]
    sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return table(list(zip(docs.column("doc_id").to_pylist(), [held] * len(texts), tokens.sizes.tolist(), sums[0], sizes, sums[1], sums[2])), SCORE_SCHEMA)


def _class_tables(rows: DataFrame, groups: int, fan: int) -> Tables:
    """Class tables from their parts (shard: part * groups + group), `fan` groups at a time."""

    def add(cells: pa.Table) -> pa.Table:
        keys, counts = merge([unpack_sorted(x, np.uint64) for x in cells.column("answer").to_pylist()], [unpack(x, np.int64) for x in cells.column("sums").to_pylist()])
        return table([[cells.column("part")[0].as_py(), cells.column("at")[0].as_py(), pack_sorted(keys), pack(counts)]], "part int, at int, answer binary, sums binary")

    rows = rows.select(F.expr(f"shard div {groups}").cast("int").alias("part"), (F.col("shard") % groups).alias("at"), "answer", "sums")
    while groups > 1:
        groups = 1 + (groups - 1) // fan
        rows = rows.withColumn("at", F.expr(f"at div {fan}").cast("int")).groupBy("part", "at").applyInArrow(add, "part int, at int, answer binary, sums binary")
    leaves = np.zeros(2 * CLASSES * CLASSES, np.float32)
    for r in rows.collect():  # 2 * _PARTS rows of a fixed size
        leaves[unpack_sorted(r["answer"], np.uint64).astype(np.int64) + (r["part"] // _PARTS) * CLASSES * CLASSES] = unpack(r["sums"], np.int64)
    return Tables(leaves.reshape(2, CLASSES, CLASSES))


def _total(rows: DataFrame, groups: int, fan: int, length: int) -> np.ndarray:
    """Sum of vectors (at long, sums binary; at below groups), `fan` at a time; in integers, so that
    their order is free."""

    def add(part: pa.Table) -> pa.Table:
        return table([[part.column("at")[0].as_py(), pack(sum(unpack(x, np.int64) for x in part.column("sums").to_pylist()))]], "at long, sums binary")

    while groups > 1:
        groups = 1 + (groups - 1) // fan
        rows = rows.withColumn("at", F.expr(f"at div {fan}")).groupBy("at").applyInArrow(add, "at long, sums binary")
    return sum((unpack(r["sums"], np.int64) for r in rows.select("sums").collect()), np.zeros(length, np.int64))  # one row


def language_scores(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    Both scores are log10 probabilities of the whole token sequence; they do not depend on how the
    table is split. Defined results: an empty table gives no rows; null and empty texts are one end
    token (bits_per_byte null); without training texts every token is unknown; a null doc_id counts
    as the id of empty text; rows of equal doc_id are scored each; other columns are ignored."""
    spark = docs.sparkSession
    size = common.text_bytes(docs)
    chunks, shards, bits = 1 + size // chunk_bytes, 1 + size // shard_bytes, context_bits(size)
    held = common.id_bucket(docs["doc_id"], FOLDS) == HELD_OUT
    lot = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    chunk = F.when(F.col("held"), F.pmod(lot, F.lit(1 + chunks // FOLDS)) + chunks).otherwise(F.pmod(lot, F.lit(chunks)))
    texts = dealt.select("doc_id", "text", chunk.cast("long").alias("chunk")).repartition("chunk").groupBy("chunk")

    asked = texts.applyInArrow(lambda g: _ask(g, chunks, shards, bits, fan), ASK_SCHEMA)
    answered = common.stage(asked.groupBy("shard").applyInArrow(lambda g: _answer(g, shards, bits), ANSWER_SCHEMA), "lm-answers")
    groups = 1 + (chunks - 1) // fan
    tables = _class_tables(answered.where(F.col("shard") >= 2 * shards).select((F.col("shard") - 2 * shards).alias("shard"), "answer", "sums"), groups, fan)
    *mass, n, v = _total(answered.where((F.col("chunk") == -1) & (F.col("shard") < shards)).select(F.col("shard").cast("long").alias("at"), "sums"), shards, fan, CLASSES + 2).tolist()
    shared = spark.sparkContext.broadcast(tables)  # fixed size
    given = answered.where("chunk >= 0").select("chunk", "shard", "answer")

    learnt = texts.cogroup(given.where((F.col("chunk") < chunks) & (F.col("shard") >= shards)).groupBy("chunk")).applyInArrow(
        lambda d, a: _learn(_training(d, chunks), a, shared.value, shards, bits), "at long, sums binary"
    )
    mixer = Mixer.of(_total(learnt, chunks, fan, Mixer.LENGTH))
    model = spark.sparkContext.broadcast((mixer, tables, np.array(mass, np.int64), n, v))  # fixed size

    scored = texts.cogroup(given.groupBy("chunk")).applyInArrow(lambda d, a: _score(d, a, model.value, chunks, shards, bits), SCORE_SCHEMA)
    per_byte = F.when(F.col("n_bytes") > 0, -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", per_byte.alias("bits_per_byte"))


def _training(docs: pa.Table, chunks: int) -> pa.Table:
    return docs if docs.num_rows and docs.column("chunk")[0].as_py() < chunks else docs.slice(0, 0)
