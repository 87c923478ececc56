"""Arrays in table cells: compressed byte planes, sorted keys as differences, flags as bits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def pack(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), 1)


def unpack(raw: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(raw, dtype), dtype=dtype)


def pack_flags(flags: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(flags).tobytes(), 1)


def unpack_flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(raw), np.uint8), count=n).astype(bool)


def table(rows: list, ddl: str) -> pa.Table:
    """An Arrow table of rows, by a schema of int, long, double, binary, string and boolean fields."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    every, n = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(every)
    every, n = every[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], (np.add.reduceat(n, first) if len(first) else n)


def runs(values: np.ndarray) -> dict[int, tuple[int, int]]:
    """(from, to) of each value that a sorted array holds."""
    edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)] if len(values) else []
    return {int(values[a]): (a, b) for a, b in zip(edges, edges[1:])}


def shard_runs(keys: np.ndarray, shards: int):
    """(shard, from, to) of sorted 64-bit keys; a shard is a range of the upper 32 bits. Shards
    without a key cost nothing, however many there are."""
    homes = np.minimum((keys >> np.uint64(32)) // np.uint64((1 << 32) // shards), np.uint64(shards - 1))
    for s, (a, b) in runs(homes).items():
        yield s, a, b
