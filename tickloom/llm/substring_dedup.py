"""Substring dedup: words covered by a window that also starts earlier in the corpus are removed.

Documents are dealt into chunks of a few MB. Pass 1: each chunk counts its windows in a count-min
sketch of two rows, whose cells are spread over shards; the chunks' sketches are added per shard,
and each chunk gets back, for the cells it touched, whether the sum is two or more. Pass 2: only
windows whose cells are both that full (an overestimate: no repeated window is missed) are grouped
exactly, by 96-bit fingerprints; the first start keeps its words. Pass 3 removes the rest.

Chunks and shards grow in number with the input, never in size. What travels between them is
sorted and packed, one row for each shard that a chunk touches: never more rows than windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, hashing
from tickloom.llm.packed import pack, pack_flags, pack_sorted, runs, table, unpack, unpack_flags, unpack_sorted

WINDOW, CHUNK_BYTES, SHARD_BYTES = 20, 4 << 20, 16 << 20
#: Cells of a shard and row, as a power of two; a shard has under 3 million windows.
CELL_BITS = 24
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
SKETCH_SCHEMA = "shard int, chunk long, cells0 binary, twice0 binary, cells1 binary, twice1 binary"
FULL_SCHEMA = "chunk long, shard int, full0 binary, full1 binary"
WINDOW_SCHEMA = "shard int, chunk long, full0 binary, full1 binary, n int, high binary, low binary, owner binary, owners binary"
LATER_SCHEMA = "chunk long, shard int, full0 binary, full1 binary, later binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


class _Chunk:
    """The windows of one chunk in corpus order: by doc_id (null first, ties by text), then start."""

    def __init__(self, group: pa.Table, window: int):
        rows = list(zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist()))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        self.ids, self.texts = [r[0] for r in rows], [r[1] for r in rows]
        parts, second, self.n_words, self.n_windows = [], [], [], []
        for text in self.texts:
            hashes = hashing.word_hashes(hashing.words_of(text, lower=False))
            self.n_words.append(len(hashes))
            parts.append(hashing.window_hashes(hashes, window))
            second.append(hashing.window_hashes(hashes, window, 0xA0761D6478BD642F).astype(np.uint32))
            self.n_windows.append(len(parts[-1]))
        self.high = np.concatenate([np.zeros(0, np.uint64), *parts])
        self.low = np.concatenate([np.zeros(0, np.uint32), *second])
        self.doc = np.repeat(np.arange(len(rows), dtype=np.uint32), self.n_windows)

    def cells(self, row: int, shards: int) -> np.ndarray:
        """Shard and cell of every window in one number."""
        m = hashing.mix(self.high ^ _SEEDS[row])
        return (((m >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32) << np.uint64(CELL_BITS)) | (m & np.uint64((1 << CELL_BITS) - 1))

    def counted(self, row: int, shards: int) -> tuple[np.ndarray, np.ndarray, dict]:
        """Cells touched (sorted), whether twice or more, and the bounds of each touched shard."""
        ordered = np.sort(self.cells(row, shards))
        first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] + np.uint64(1)) != 0) if len(ordered) else np.zeros(0, np.int64)
        found = ordered[first]
        twice = np.diff(first, append=len(ordered)) > 1
        return found, twice, runs(found >> np.uint64(CELL_BITS))


def _sketch(group: pa.Table, window: int, shards: int) -> pa.Table:
    chunk, own = group.column("chunk")[0].as_py(), _Chunk(group, window)
    low = np.uint64((1 << CELL_BITS) - 1)
    rows = [own.counted(r, shards) for r in (0, 1)]
    out = []
    for s in sorted(rows[0][2].keys() | rows[1][2].keys()):
        line = [s, chunk]
        for cells, twice, bounds in rows:
            a, b = bounds.get(s, (0, 0))
            line += [pack_sorted((cells[a:b] & low).astype(np.uint32)), pack_flags(twice[a:b])]
        out.append(line)
    return table(out, SKETCH_SCHEMA)


def _add(group: pa.Table) -> pa.Table:
    """One shard: the sum of the chunks' sketches, and each chunk's cells that reach two."""
    columns = group.to_pydict()
    full = {0: [], 1: []}
    for row in (0, 1):
        total = np.zeros(1 << CELL_BITS, np.uint8)
        for raw, twice in zip(columns[f"cells{row}"], columns[f"twice{row}"]):
            cells = unpack_sorted(raw, np.uint32)
            total[cells] = np.minimum(total[cells] + np.uint8(1) + unpack_flags(twice, len(cells)).astype(np.uint8), 2)
        for raw in columns[f"cells{row}"]:
            full[row].append(pack_flags(total[unpack_sorted(raw, np.uint32)] >= 2))
    return table(list(zip(columns["chunk"], columns["shard"], full[0], full[1])), FULL_SCHEMA)


def _estimated(own: _Chunk, answers: dict, shards: int) -> np.ndarray:
    """Whether each window's estimated count is two or more."""
    out = np.ones(len(own.high), bool)
    for row in (0, 1):
        cells, _, bounds = own.counted(row, shards)
        full = np.zeros(len(cells), bool)
        for s, raw in zip(answers["shard"], answers[f"full{row}"]):
            a, b = bounds.get(s, (0, 0))
            full[a:b] = unpack_flags(raw, b - a)
        keys = own.cells(row, shards)
        out &= full[np.searchsorted(cells, keys)] if len(cells) else False
    return out


def _repeated(own: _Chunk, answers: dict, shards: int):
    """Windows estimated repeated, by fingerprint and place: their order, which of them are the
    first of their fingerprint in the chunk, and the bounds of those firsts in each shard."""
    at = np.flatnonzero(_estimated(own, answers, shards))
    home = own.cells(0, shards)[at] >> np.uint64(CELL_BITS)
    order = at[np.lexsort((at, own.low[at], own.high[at], home))]
    high, low = own.high[order], own.low[order]
    first = np.ones(len(order), bool)
    first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    homes = own.cells(0, shards)[order[first]] >> np.uint64(CELL_BITS)
    return order, first, runs(homes)


def _candidates(docs: pa.Table, answers: pa.Table, window: int, shards: int) -> pa.Table:
    if not docs.num_rows:
        return table([], WINDOW_SCHEMA)
    chunk, own, answers = docs.column("chunk")[0].as_py(), _Chunk(docs, window), answers.to_pydict()
    order, first, bounds = _repeated(own, answers, shards)
    firsts = order[first]
    ids = np.array([np.iinfo(np.int64).min if i is None else i for i in own.ids], np.int64)
    out = []
    for s, full0, full1 in zip(answers["shard"], answers["full0"], answers["full1"]):
        a, b = bounds.get(s, (0, 0))
        mine = firsts[a:b]
        owners, owner = np.unique(own.doc[mine], return_inverse=True)
        out.append([s, chunk, full0, full1, len(mine), pack_sorted(own.high[mine]), own.low[mine].tobytes(), pack(owner.astype(np.uint32)), pack_sorted(ids[owners])])
    return table(out, WINDOW_SCHEMA)


def _group(group: pa.Table) -> pa.Table:
    """One shard: exact groups of the candidates; a chunk learns which of its windows start earlier
    in another chunk (smaller doc_id; rows of equal doc_id in two chunks: smaller chunk)."""
    c = group.to_pydict()
    sizes = np.array(c["n"], np.int64)
    high = np.concatenate([unpack_sorted(x, np.uint64) for x in c["high"]])
    low = np.concatenate([np.frombuffer(x, np.uint32) for x in c["low"]])
    doc = np.concatenate([unpack_sorted(ids, np.int64)[unpack(at, np.uint32)] if n else np.zeros(0, np.int64) for n, at, ids in zip(c["n"], c["owner"], c["owners"])])
    order = np.lexsort((np.repeat(np.array(c["chunk"], np.int64), sizes), doc, low, high))
    again = np.zeros(len(order), bool)
    again[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    later = np.zeros(len(order), bool)
    later[order] = again
    ends = np.cumsum(sizes)
    return table([[k, s, f0, f1, pack_flags(later[e - n : e])] for k, s, f0, f1, n, e in zip(c["chunk"], c["shard"], c["full0"], c["full1"], sizes, ends)], LATER_SCHEMA)


def _remove(docs: pa.Table, answers: pa.Table, window: int, shards: int) -> pa.Table:
    if not docs.num_rows:
        return table([], RESULT_SCHEMA)
    own, answers = _Chunk(docs, window), answers.to_pydict()
    order, first, bounds = _repeated(own, answers, shards)
    later = np.zeros(int(first.sum()), bool)
    for s, raw in zip(answers["shard"], answers["later"]):
        a, b = bounds.get(s, (0, 0))
        later[a:b] = unpack_flags(raw, b - a)
    gone = ~first
    gone[first] = later
    starts = np.zeros(len(own.high), bool)
    starts[order[gone]] = True
    out, at = [], 0
    for doc_id, text, n_words, n in zip(own.ids, own.texts, own.n_words, own.n_windows):
        words = hashing.words_of(text, lower=False)
        edge = np.zeros(n_words + 1, np.int64)
        begins = np.flatnonzero(starts[at : at + n])
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept = words if not len(begins) else [w for w, c in zip(words, covered.tolist()) if not c]
        out.append([doc_id, n_words, n_words - len(kept), b" ".join(kept).decode("utf-8", "replace")])
        at += n
    return table(out, RESULT_SCHEMA)


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words joined by one space, without those covered by
    a window of `window` words that also starts earlier (smaller doc_id, or earlier in the text).

    Defined results: an empty table gives no rows; a null or empty text has no words and an empty
    kept_text; texts shorter than the window are kept whole; null ids come before all others; rows
    of equal doc_id are ordered by text, or by chunk where they fall into two; equal rows fall into
    one chunk and the first keeps its words; other columns are ignored."""
    size = common.text_bytes(docs)
    chunks, shards = 1 + size // chunk_bytes, 1 + size // shard_bytes
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The three passes read the same exchange of the texts.
    dealt = plain.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")
    texts = dealt.groupBy("chunk")
    sketches = texts.applyInArrow(lambda g: _sketch(g, window, shards), SKETCH_SCHEMA)
    full = sketches.groupBy("shard").applyInArrow(_add, FULL_SCHEMA)
    found = texts.cogroup(full.groupBy("chunk")).applyInArrow(lambda d, a: _candidates(d, a, window, shards), WINDOW_SCHEMA)
    later = found.groupBy("shard").applyInArrow(_group, LATER_SCHEMA)
    return texts.cogroup(later.groupBy("chunk")).applyInArrow(lambda d, a: _remove(d, a, window, shards), RESULT_SCHEMA)
