"""Hashes of all windows of a block of texts, from prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads a 64-bit number over all its bits, one to one."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of byte windows.  The base is odd, so the power of a window's start can be divided out."""

    def __init__(self, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 61, 1 << 63, dtype=np.uint64)) | 1
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """Prefix sums of a block; hand them to :meth:`of`."""
        if len(self.powers) <= len(raw):
            size = max(1 << 16, len(raw) + 1)
            for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return mixed((sums[start + size] - sums[start]) * self.inverse[start])
