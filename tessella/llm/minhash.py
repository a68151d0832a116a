"""MinHash signatures, band keys and the posterior test on partial signatures."""

from __future__ import annotations

from math import comb

import numpy as np

from tessella.llm.words import mix

BLOCK = 4096


class MinHasher:
    """``bands`` bands of ``rows`` hashes each, out of a signature of ``size`` values."""

    def __init__(self, size: int, bands: int, rows: int, seed: int = 20_240_229):
        assert bands * rows <= size
        self.size, self.bands, self.rows = size, bands, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**32, size, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, size, dtype=np.uint32)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The signature of a set of 64-bit hashes that isn't empty."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), BLOCK):
            np.minimum(low, (x[i : i + BLOCK, None] * self.a + self.b).min(0), out=low)
        return low

    def minima_of(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The signatures of sets that lie one after the other, none empty: a row a set; ends[0] is 0."""
        out = np.empty((len(ends) - 1, self.size), np.uint32)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
            x = hashes[ends[i] : ends[j]]
            if j == i + 1:
                out[i] = self.minima(x)
            else:
                x = (x >> np.uint64(32)).astype(np.uint32)
                out[i:j] = np.minimum.reduceat(x[:, None] * self.a + self.b, ends[i:j] - ends[i], axis=0)
            i = j
        return out

    def packed(self, minima: np.ndarray) -> bytes:
        """The low 16 bits of each value: what signatures are compared by."""
        return minima.astype(np.uint16).tobytes()

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        return self.keys_of(minima[None])[0]

    def keys_of(self, minima: np.ndarray) -> np.ndarray:
        """The keys of several signatures, a row each."""
        part = minima[:, : self.bands * self.rows].reshape(len(minima), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(self.salt, part.shape[:2])
        for i in range(self.rows):
            key = mix(key + part[:, :, i])
        return key.view(np.int64)


class Posterior:
    """Prunes pairs whose similarity is too unlikely to reach the threshold.

    With a uniform prior, m matches in n hashes leave a Beta(m + 1, n - m + 1)
    posterior for the similarity.  P(similarity >= t) is then the probability
    that a Binomial(n + 1, t) variable is at most m.  After each batch a pair
    goes if that probability is below ``miss``.
    """

    def __init__(self, size: int, threshold: float, miss: float, batch: int = 16):
        self.batch = batch
        self.least = {n: self._least(n, threshold, miss) for n in range(batch, size + 1, batch)}

    @staticmethod
    def _least(n: int, t: float, miss: float) -> int:
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                return m
        return n

    def alive(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Indices of the rows of two signature matrices that pass every batch."""
        rows = np.arange(len(left))
        matches = np.zeros(len(left), np.int64)
        for n, least in self.least.items():
            s = slice(n - self.batch, n)
            matches = matches + (left[rows, s] == right[rows, s]).sum(1)
            keep = matches >= least
            rows, matches = rows[keep], matches[keep]
        return rows
