"""Measures of sequences that need no tables."""

from __future__ import annotations


def common_length(a, b) -> int:
    """Length of the longest common subsequence: one bit of an integer for each token of ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")
