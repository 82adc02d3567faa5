"""Polynomial hashes over byte arrays, all positions at once.

Hashes are taken modulo 2^64 with an odd base, which has an inverse, so the hash of any stretch follows
from two prefix sums. Bytes are first mapped to random-looking 64-bit values. Where equality of texts matters,
callers compare the bytes as well or mix the result into wide keys.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the information of every bit over the whole word."""
    h = (h ^ (h >> U64(30))) * MIX
    h = (h ^ (h >> U64(27))) * MIX2
    return h ^ (h >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x632BE59BD9B4E019))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                grown = np.full(size, base, U64)
                grown[0] = 1
                setattr(self, name, np.multiply.accumulate(grown))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """``p`` with ``p[i]`` the sum over the first ``i`` bytes; ``data`` is uint8."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def stretch(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``, independent of where it lies."""
    _, down = POWERS.upto(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def windows(prefix: np.ndarray, width: int) -> np.ndarray:
    """Hash of every stretch of ``width`` bytes."""
    if len(prefix) <= width:
        return np.zeros(0, U64)
    _, down = POWERS.upto(len(prefix))
    return (prefix[width:] - prefix[:-width]) * down[: len(prefix) - width]
