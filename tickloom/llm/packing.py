"""Packing along a space-filling curve.

Each document's token ids become a hashed vector, a fixed Gaussian projection takes it to three
dimensions, and its place on a Hilbert curve through them is the sort key. Range partitions of the
curve are cut into sequences: documents follow each other along the curve, so a sequence holds
neighbours. What is left at the end of a partition is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, tokens

DIMS, BITS, HASHED = 3, 16, 4096
#: Half-width of the cube that the projection is cut to; its components have unit variance.
SPAN = 4.0
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer coordinates (n x dims, each below 2**bits), after Skilling (2004):
    undo the excess work of the axes bit by bit, Gray-code, and interleave the transposed bits."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20_04).standard_normal((HASHED, DIMS)).astype(np.float32)


def curve_points(arrays: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Grid coordinates of each id array: log counts of hashed ids, scaled to length one, projected."""
    out = np.zeros((len(arrays), DIMS))
    logs = np.log1p(np.arange(1 + max(map(len, arrays), default=0))).astype(np.float32)
    for k, ids in enumerate(arrays):
        slots = (ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(20)
        weights = logs[np.bincount(slots, minlength=HASHED)]
        norm = np.sqrt(weights @ weights)
        if norm:
            out[k] = (weights @ projection) / norm
    top = (1 << BITS) - 1
    return np.clip((out + SPAN) / (2 * SPAN) * top, 0, top).astype(np.int64)


def encode_on_curve(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, curve, ids) of every row; staged, since sorting reads it twice."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, projection = tokens.encoder(vocabulary), _projection()
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in common.slices(batches):
            ids = [enc.encode(t) + end for t in batch.column("text").to_pylist()]
            arrays = [np.frombuffer(x, enc.dtype) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(a) for a in arrays], pa.int64()), pa.array(hilbert_key(curve_points(arrays, projection), BITS)), pa.array(ids, pa.binary())],
                names=["doc_id", "n_tokens", "curve", "ids"],
            )

    return common.stage(docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, curve long, ids binary"), "curve-ids")


class Packer:
    """Cuts a stream of documents into sequences; `rows` are (doc_id, start, length, crc, doc_tokens,
    sequence, offset). The pieces of the sequence that is still open are held back until it is full."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.filled, self.open = 0, []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.size - self.filled)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.filled, at = self.filled + take, at + take
            if self.filled == self.size:
                self._close(self.open)
                self.filled, self.open = 0, []

    def finish(self) -> None:
        """Cut what is open at powers of two, largest first."""
        held, left = self.open, self.filled
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            taken = []
            while want:
                doc_id, start, ids, n = held[0]
                if len(ids) <= want:
                    taken.append(held.pop(0))
                else:
                    taken.append((doc_id, start, ids[:want], n))
                    held[0] = (doc_id, start + want, ids[want:], n)
                want -= len(taken[-1][2])
            self._close(taken)
        self.filled, self.open = 0, []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `size` ids along the curve.

    Equal keys (copies) are ordered, and split over partitions, by a hash of doc_id, so a large
    group of copies is no large task. A sequence number is the partition in the high and a counter
    in the low 32 bits. Defined results: an empty table gives no rows; a null or empty text is the
    end id alone; rows of equal doc_id are separate documents; a null doc_id stays null; other
    columns are ignored."""
    encoded = encode_on_curve(docs, vocabulary, end_id)
    n = common.partitions_for(docs)
    keys = ["curve", F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("ids")]
    ordered = encoded.repartitionByRange(n, *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(size, TaskContext.get().partitionId() << 32)
        dtype = tokens.encoder(vocabulary).dtype
        for batch in common.slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                packer.add(doc_id, np.frombuffer(ids, dtype))
            yield packer.take()
        packer.finish()
        yield packer.take()

    return ordered.select("doc_id", "ids").mapInArrow(pack, PIECE_SCHEMA)
