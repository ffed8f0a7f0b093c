"""Rolling hashes of spans by prefix polynomials modulo 2^64, in NumPy."""

from __future__ import annotations

import numpy as np

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, modulo 2^64; kept by the worker for its next slices."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        factors = np.array([[base], [pow(base, -1, 1 << 64)]], dtype=np.uint64).repeat(n, axis=1)
        factors[:, 0] = 1
        held = _POWERS[base] = tuple(np.cumprod(factors, axis=1))
    return held[0][:n], held[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(digits: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial of the digits of each span, by one prefix sum; equal spans have equal values wherever they are."""
    up, down = powers(base, len(digits) + 1)
    sums = np.zeros(len(digits) + 1, dtype=np.uint64)
    np.cumsum(digits * up[:len(digits)], out=sums[1:])
    return (sums[stop] - sums[start]) * down[start]
