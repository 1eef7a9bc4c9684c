"""Byte grams as 64-bit integers and a hash index over them, for arrays."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes up to and with each byte from number ``length - 1`` on, first byte highest."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = data[:n].astype(np.uint64)
    for k in range(1, length):
        out <<= np.uint64(8)
        out |= data[k : n + k]
    return out


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their numbers or sums of weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], (np.add.reduceat(weights, first) if len(first) else weights[:0])


class Index:
    """Position of a key in an array of distinct keys; open addressing, half full at most."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = (keys if len(keys) else np.zeros(1, np.uint64)), np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(rest):
            # Of the keys at a free slot the last one written has it.
            free = self.at[slot] < 0
            self.at[slot[free]] = rest[free]
            left = self.at[slot] != rest
            rest, slot = rest[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 for keys that aren't there."""
        slot = self._slot(keys)
        out = self.at[slot]
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            at = self.at[slot]
            out[wrong] = at
            on = (at >= 0) & (self.keys[at] != keys[wrong])
            wrong, slot = wrong[on], slot[on]
        return out
