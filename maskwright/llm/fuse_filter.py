"""Static binary fuse filter (three segments, 8-bit fingerprints), built and probed with whole-array operations."""

from __future__ import annotations

import math
import struct

import numpy as np

from .common import mix64

_HEAD = struct.Struct("<QIIQ")


def _place(keys: np.ndarray, seed: int, seg: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix64(keys + np.uint64(seed))
    mask = np.uint64(seg - 1)
    first = ((h >> np.uint64(32)) * np.uint64(seg * count)) >> np.uint64(32)
    second = (first + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * seg)) ^ (h & mask)
    print_ = ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), print_


def _peel(at: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each alone holds); None if some keys can't be peeled."""
    n = at.shape[1]
    degree = np.bincount(at.ravel(), minlength=slots)
    owner = np.zeros(slots, np.int64)
    np.bitwise_xor.at(owner, at.ravel(), np.tile(np.arange(n), 3))
    rounds, left, front = [], n, np.flatnonzero(degree == 1)
    while front.size:
        keys, where = np.unique(owner[front], return_index=True)
        rounds.append((keys, front[where]))
        left -= keys.size
        touched = at[:, keys].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(owner, touched, np.tile(keys, 3))
        touched = np.unique(touched)
        front = touched[degree[touched] == 1]
    return rounds if not left else None


def build(keys: np.ndarray) -> bytes:
    """A filter over the distinct 64-bit keys; no key is ever missed, others pass with a chance of 1/256."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = keys.size
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    seg = 4 if n < 4 else min(1 << int(math.log(n) / math.log(3.33) + 2.25), 1 << 18)
    factor = 2.0 if n < 4 else max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, math.ceil(round(n * factor) / seg) - 2)
    for attempt in range(200):
        seed = int(mix64(np.array([attempt + 1], np.uint64))[0])
        at, prints = _place(keys, seed, seg, count)
        rounds = _peel(at, seg * (count + 2))
        if rounds is not None:
            break
        count += attempt % 4 == 3
    else:
        raise RuntimeError("the binary fuse filter could not be built")
    cells = np.zeros(seg * (count + 2), np.uint8)
    for peeled, slot in reversed(rounds):
        a, b, c = at[:, peeled]
        cells[slot] = prints[peeled] ^ cells[a] ^ cells[b] ^ cells[c]
    return _HEAD.pack(seed, seg, count, n) + cells.tobytes()


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys).astype(np.uint64)
    seed, seg, count, n = _HEAD.unpack_from(blob)
    if not n or not keys.size:
        return np.zeros(keys.size, bool)
    cells = np.frombuffer(blob, np.uint8, offset=_HEAD.size)
    (a, b, c), prints = _place(keys, seed, seg, count)
    return (cells[a] ^ cells[b] ^ cells[c]) == prints
