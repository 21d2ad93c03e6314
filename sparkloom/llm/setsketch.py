"""Set sketches with exponentially spaced, truncated minima: mergeable, locality-sensitive, compared by likelihood.

Register i holds floor(1 - log_b(x)) of the smallest of the exponential variates that a hash gives the elements,
cut to 0 .. q + 1. The sketch of a union is the larger of each register.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from sparkloom.llm.common import WordHashes, mix, words

STEP = 512


def shingles(found: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; of fewer words, the whole sequence is one."""
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(found)
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def text_shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    return shingles(words(text, lower=True), size, hashes)


@dataclass(frozen=True)
class Sketcher:
    """``bands`` bands of ``rows`` registers each; ``base`` close to 1 makes a register agree with a probability near the Jaccard similarity."""

    bands: int = 32
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65_534

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def registers(self, elements: np.ndarray) -> np.ndarray:
        seeds = mix(np.arange(1, 2 * self.size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        factor, shift = (seeds[:self.size] | np.uint64(1))[:, None], seeds[self.size:][:, None]
        least = np.full(self.size, np.iinfo(np.uint64).max)
        for at in range(0, len(elements), STEP):
            least = np.minimum(least, (elements[None, at:at + STEP] * factor + shift).min(axis=1))
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0 ** 64) / self.rate
        return np.clip(np.floor(1 - np.log(x) / math.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    def band_keys(self, registers: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each row of registers."""
        packed = registers.reshape(len(registers), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), packed.shape[:2])
        for i in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + packed[:, :, i])
        return key.view(np.int64)

    def similarity(self, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
        """Maximum-likelihood Jaccard similarity of rows of registers of sets with known sizes.

        The likelihood uses how many registers are larger on the left, larger on the right, and equal.
        """
        up, down = (left > right).sum(1).astype(float), (left < right).sum(1).astype(float)
        same = left.shape[1] - up - down
        u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
        low, high = np.zeros(len(u)), np.minimum(n_left, n_right) / np.maximum(n_left, n_right)

        def chance(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / math.log(self.base)

        def likelihood(j: np.ndarray) -> np.ndarray:
            p, q = chance(u - v * j), chance(v - u * j)
            return up * np.log(np.maximum(p, 1e-300)) + down * np.log(np.maximum(q, 1e-300)) + same * np.log(np.maximum(1 - p - q, 1e-300))

        golden = (math.sqrt(5) - 1) / 2
        for _ in range(30):  # the likelihood has one peak
            a, b = high - golden * (high - low), low + golden * (high - low)
            left_better = likelihood(a) >= likelihood(b)
            low, high = np.where(left_better, low, a), np.where(left_better, b, high)
        return (low + high) / 2


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(left, right)
