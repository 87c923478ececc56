"""Word hashes and rolling window hashes of whole texts, vectorised per document."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D; `lower` folds A-Z only."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """Hash of every window of `size` words: a polynomial built by doubling, then mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, covered = np.zeros(n, np.uint64), 0
    power, width, block = multiplier, 1, hashes
    bits = size
    while bits:
        if bits & 1:
            total = total * np.uint64(pow(multiplier, width, 1 << 64)) + block[covered : covered + n]
            covered += width
        bits >>= 1
        if bits:
            block = block[:-width] * np.uint64(power) + block[width:]
            power = power * power & _MASK
            width *= 2
    return mix(total)


def crc32_sql(text: str) -> str:
    """A DuckDB expression for the unsigned crc32 of a text's UTF-8 bytes, a bit at a time."""
    octets = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    steps = f"flatten([[4294967295::BIGINT], flatten(list_transform({octets}, lambda o: [o, -1, -1, -1, -1, -1, -1, -1, -1]))])"
    return f"xor(list_reduce({steps}, lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"
