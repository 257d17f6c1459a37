"""Minimal perfect hashing of 128-bit keys, in levels of bit arrays.

Each level sends the keys that are left to twice as many places; a key that is alone in its place stays
there, the others go on. A key's number is the count of set bits before its own: about three bits a key.
"""

from __future__ import annotations

import numpy as np

ROOM = 2.0
MAX_LEVELS = 64


def _place(high: np.ndarray, low: np.ndarray, level: int, places: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = high + np.uint64(level * 2 + 1) * (low | np.uint64(1))
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return (x % np.uint64(places)).astype(np.int64)


def build(high: np.ndarray, low: np.ndarray) -> tuple[list[int], bytes]:
    """Sizes of the levels and their packed bits, for distinct keys."""
    sizes, bits = [], []
    for level in range(MAX_LEVELS):
        if not len(high):
            break
        places = max(8, int(ROOM * len(high)))
        at = _place(high, low, level, places)
        alone = np.bincount(at, minlength=places) == 1
        sizes.append(places)
        bits.append(alone)
        left = ~alone[at]
        high, low = high[left], low[left]
    if len(high):
        raise ValueError("keys are not distinct")
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


class Lookup:
    def __init__(self, sizes: list[int], packed: bytes):
        self.sizes = [int(s) for s in sizes]
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(self.sizes)).view(bool)
        self.before = np.cumsum(self.bits, dtype=np.uint32)

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; for keys that were not there when it was built any number, or -1."""
        out, left, base = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, places in enumerate(self.sizes):
            at = base + _place(high[left], low[left], level, places)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]].astype(np.int64) - 1
            left, base = left[~hit], base + places
        return out
