"""Keyed permutations of 0 .. size - 1 that need no table: any task computes any place."""

from __future__ import annotations

from functools import partial

import numpy as np

ROUNDS = 6


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(index: np.ndarray, size: int, key: int, rounds: int = ROUNDS, back: bool = False) -> np.ndarray:
    """A permutation of 0 .. size - 1: Feistel rounds over the next even number of bits, walked until inside. back: its
    inverse, the same rounds undone."""
    half = max(1, -(-max(1, size - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1)))
    mixed = lambda half_word, k: (mix64(half_word.astype(np.uint64) + k) & mask).astype(np.int64)
    if len(index) > 1 << half:  # fewer half words than places: each is mixed once
        every = np.arange(1 << half)
        steps = [mixed(every, k).take for k in keys]
    else:
        steps = [partial(mixed, k=k) for k in keys]
    out = index.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        now = out if len(todo) == len(out) else out[todo]
        left, right = now >> half, now & ((1 << half) - 1)
        for step in steps[::-1] if back else steps:
            left, right = (right ^ step(left), left) if back else (right, left ^ step(right))
        now = (left << half) | right
        out[todo] = now
        todo = todo[now >= size]
    return out
