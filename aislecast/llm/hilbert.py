"""Hilbert order of points, several points at a time."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of grid cells (non-negative, below ``2**bits``).

    The axes are turned bit by bit, from the highest: a set bit inverts the
    lower bits of the first axis, a clear one exchanges them with the axis at
    hand; a Gray code over all axes ends the turn. Keys need
    ``bits * dimensions`` bits, at most 63.
    """
    x = np.array(cells, dtype=np.int64).T.copy()
    n = len(x)
    if bits * n > 63:
        raise ValueError("keys longer than 63 bits")
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        low = q - 1
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = np.int64(1) << level
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key
