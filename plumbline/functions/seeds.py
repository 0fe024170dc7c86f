"""Logical seeds and a counter-based generator (SplitMix64), independent of partitions and threads.

Computed on the driver: ANSI SQL raises on the 64-bit overflow that the mixing needs.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
# Fixed values of SplitMix64 and 64-bit FNV-1a.
_GAMMA = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_FNV_START, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * _MIX_1 & _MASK
    x = (x ^ (x >> 27)) * _MIX_2 & _MASK
    return x ^ (x >> 31)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def derive(seed: int, operation: str, index: int = 0) -> int:
    """The seed of a named, numbered part of the work that ``seed`` governs (signed 64-bit)."""
    name = _FNV_START
    for byte in operation.encode():
        name = (name ^ byte) * _FNV_PRIME & _MASK
    return _signed(_mix((seed & _MASK) ^ _mix(name) ^ _mix(index & _MASK)))


class Rng:
    """Immutable generator: each draw returns its value and the next generator."""

    def __init__(self, seed: int) -> None:
        self.state = seed & _MASK

    def next_int64(self) -> tuple[int, Rng]:
        following = Rng(self.state + _GAMMA)
        return _signed(_mix(following.state)), following

    def next_float(self) -> tuple[float, Rng]:
        """Uniform in [0, 1), from the 53 highest bits."""
        value, following = self.next_int64()
        return ((value & _MASK) >> 11) / (1 << 53), following

    def draws(self, n: int) -> np.ndarray:
        """The next ``n`` values at once, unsigned: the generator only counts, so they vectorise."""
        x = np.uint64(self.state) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX_2)
        return x ^ (x >> np.uint64(31))


def permutation(n: int, seed: int) -> np.ndarray:
    """Fisher-Yates order of 0..n-1 from the last place down, one draw modulo (place + 1) each."""
    order = np.arange(n)
    places = np.arange(n - 1, 0, -1)
    for i, j in zip(places.tolist(), (Rng(seed).draws(max(n - 1, 0)) % (places + 1).astype(np.uint64)).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return order
