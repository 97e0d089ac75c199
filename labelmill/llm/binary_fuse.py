"""A static binary-fuse filter in numpy: three places in neighbouring segments, 8-bit fingerprints.

About nine bits a key; every key of the set passes, and of others one in 256 does. It is built
by peeling: in each round all keys that are alone at some place leave together, and fingerprints
are set in the opposite order. The set never changes, so there is no insertion.
"""

from __future__ import annotations

import math

import numpy as np

from labelmill.llm.arrays import mix

ROUNDS_OF_SEEDS = 64


def layout(n: int) -> tuple[int, int]:
    """(segment length, number of segments a key can start in) for ``n`` keys."""
    segment = 1 << min(18, max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return segment, max(1, math.ceil(n * factor / segment) - 2)


def places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(3 x n places, fingerprints)."""
    h = mix(keys, seed)
    span = np.uint64(segment * segments)
    first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
    low = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(14)) & low)
    third = (first + np.uint64(2 * segment)) ^ (h & low)
    return np.stack((first, second, third)).astype(np.int64), (mix(h, 1) >> np.uint64(56)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, fingerprints) of distinct uint64 ``keys``."""
    keys = np.unique(np.asarray(keys, np.uint64))
    segment, segments = layout(len(keys))
    size = segment * (segments + 2)
    for seed in range(1, ROUNDS_OF_SEEDS):
        at, prints = places(keys, seed, segment, segments)
        load = np.bincount(at.ravel(), minlength=size)
        who = np.zeros(size, np.int64)
        for row in at:
            np.add.at(who, row, np.arange(len(keys)))
        order, open_ = [], np.flatnonzero(load == 1)
        while len(open_):
            leaving, pick = np.unique(who[open_], return_index=True)
            order.append((leaving, open_[pick]))
            touched = at[:, leaving].ravel()
            np.subtract.at(load, touched, 1)
            np.subtract.at(who, touched, np.tile(leaving, 3))
            touched = np.unique(touched)
            open_ = touched[load[touched] == 1]
        if sum(len(k) for k, _ in order) == len(keys):
            table = np.zeros(size, np.uint8)
            for leaving, place in reversed(order):
                a, b, c = at[:, leaving]
                table[place] = 0
                table[place] = prints[leaving] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, table.tobytes()
        segments += 1 + segments // 16
        size = segment * (segments + 2)
    raise ValueError("no seed peels this set")


def contains(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    at, prints = places(np.asarray(keys, np.uint64), seed, segment, segments)
    t = np.frombuffer(table, np.uint8)
    return (t[at[0]] ^ t[at[1]] ^ t[at[2]]) == prints
