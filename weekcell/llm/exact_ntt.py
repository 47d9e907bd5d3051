"""Number-theoretic transforms of many rows at once, modulo 3 * 2**30 + 1.

The prime has roots of unity of every order up to 2**30 and products of two residues fit 64 unsigned bits. Arrays are laid out as
(length, rows), so that the inner loops run over rows where transforms are short.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The prime and a generator of its multiplicative group.
PRIME = 3 * 2 ** 30 + 1
GENERATOR = 5

_P = np.uint64(PRIME)
_32 = np.uint64(32)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x mod p in place for x < 2p."""
    return np.minimum(x, x - _P, out=x)


@lru_cache(maxsize=128)
def _twiddles(half: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to half - 1 of a root of order 2 * half, and each times 2**32 / p (for products without a division)."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(half, dtype=np.uint64)
    done = 1
    while done < half:
        step = np.uint64(pow(root, done, PRIME))
        more = min(done, half - done)
        powers[done:done + more] = powers[:more] * step % _P
        done += more
    return powers[:, None], ((powers << _32) // _P)[:, None]


def _times(x: np.ndarray, w: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """x * w mod p for x < 2**32: the quotient is estimated with ``scaled``, at most one too small."""
    quotient = x * scaled
    quotient >>= _32
    quotient *= _P
    out = x * w
    out -= quotient
    return _reduce(out)


def transform(x: np.ndarray) -> np.ndarray:
    """The transform of each column of residues x (length a power of two), in bit-reversed order."""
    n, rows = x.shape
    x = x.copy()
    half = n // 2
    while half:
        pairs = x.reshape(n // (2 * half), 2, half, rows)
        a, b = pairs[:, 0], pairs[:, 1]
        total = _reduce(a + b)
        gap = a - b
        gap = np.minimum(gap, gap + _P, out=gap)
        if half > 1:
            gap = _times(gap, *_twiddles(half, False))
        pairs[:, 0], pairs[:, 1] = total, gap
        half //= 2
    return x


def inverse(x: np.ndarray) -> np.ndarray:
    """Columns of which ``transform`` made x. x is overwritten."""
    n, rows = x.shape
    half = 1
    while half < n:
        pairs = x.reshape(n // (2 * half), 2, half, rows)
        a, b = pairs[:, 0], pairs[:, 1]
        if half > 1:
            b = _times(b, *_twiddles(half, True))
        total = _reduce(a + b)
        gap = a - b
        pairs[:, 1] = np.minimum(gap, gap + _P, out=gap)
        pairs[:, 0] = total
        half *= 2
    scale = pow(n, PRIME - 2, PRIME)
    return _times(x, np.uint64(scale), np.uint64((scale << 32) // PRIME))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b % _P
