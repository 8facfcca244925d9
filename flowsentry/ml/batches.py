"""Rows of an Arrow batch, scored in Python."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Odd multipliers of a row's numbers, read as whole ones.
_ODD = np.random.default_rng(0).integers(1 << 62, size=1024) * 2 + 1


def once(x: np.ndarray, scored: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``scored(x)``, one number per row, where rows of equal bits are scored once.

    Rows are told apart by a 64-bit sum and then compared in full, so a collision only means that all rows are scored.
    """
    x = np.ascontiguousarray(x, float)
    if len(x) < 2:
        return scored(x)
    bits = x.view("i8")
    mixed = bits ^ (bits >> 29)
    _, first, which = np.unique((mixed * _ODD[: x.shape[1]]).sum(1), return_index=True, return_inverse=True)
    if len(first) > len(x) * 0.9 or not np.array_equal(bits, bits[first][which]):
        return scored(x)
    return scored(x[first])[which]
