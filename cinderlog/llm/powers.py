"""Powers for rolling sums: the hash of any stretch is a difference of two running sums, moved to the stretch's start."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0xD6E8FEB86659FD93


@functools.lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    run = lambda b: np.cumprod(np.append(np.uint64(1), np.full(n - 1, b, np.uint64)), dtype=np.uint64)
    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number modulo 2**64, and of its inverse."""
    return _table(1 << max(21, (n - 1).bit_length()))
