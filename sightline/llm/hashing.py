"""Vectorised 64-bit hashes of parts of byte strings, from differences of one running sum."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(7)
SYMBOL = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, for n places."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, UNBASE)):
            _powers[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 2**17), b, np.uint64))))
    return _powers[0][:n], _powers[1][:n]


class PartHashes:
    """Hashes of any parts of one byte string."""

    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.total = np.concatenate(([np.uint64(0)], np.cumsum(SYMBOL[raw] * up[:-1])))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of the parts of one length at every place."""
        n = len(self.total) - length
        return mix((self.total[length:] - self.total[:n]) * self.down[:n])
