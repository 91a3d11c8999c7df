"""Word shingles as 64-bit hashes, vectorized over a text's bytes."""

from __future__ import annotations

import numpy as np

_B = 0x9E3779B97F4A7C15                                   # odd, so it has an inverse mod 2^64
_INVERSE = pow(_B, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of any byte spans of a text from one prefix sum."""

    def __init__(self):
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power), 1 << 16)
            self.power, self.inverse = self._powers(_B, n), self._powers(_INVERSE, n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        factors = np.full(n, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Entry k covers ``data[:k]``."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], dtype=np.uint64, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Shingler:
    """Distinct shingles of ``size`` words (runs of bytes other than blank and
    0x09-0x0D, A-Z lower-cased). A text with fewer words is one shingle, a text
    without words has none."""

    def __init__(self, size: int = 5):
        self.size, self.hash = size, SpanHash()

    def words(self, raw: bytes) -> np.ndarray:
        data = np.frombuffer(raw.lower(), np.uint8)
        if not len(data):
            return np.empty(0, np.uint64)
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        return self.hash.spans(self.hash.prefix(data), edge[::2], edge[1::2])

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        w = self.words(text.encode()) if text else np.empty(0, np.uint64)
        if not len(w):
            return w
        k = np.uint64(0xD6E8FEB86659FD93)
        n = min(self.size, len(w))
        h = np.full(len(w) - n + 1, np.uint64(n))
        for i in range(n):
            h = h * k + w[i:len(w) - n + 1 + i]
        return np.unique(mix(h))
