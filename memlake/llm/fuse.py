"""Static binary-fuse filters (three-wise, 8-bit fingerprints), after the published construction
by Graf and Lemire. NumPy on one bounded key block; Spark deals the blocks out."""

from __future__ import annotations

import math
import struct

import numpy as np

_HEAD = "<QIII"
_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = x + _U(seed)
        h ^= h >> _U(33)
        h *= _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(33)
        h *= _U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> _U(33))


def _slots(h: np.ndarray, seg_len: int, seg_count: int) -> np.ndarray:
    first = ((h >> _U(32)) * _U(seg_len * seg_count)) >> _U(32)
    mask = _U(seg_len - 1)
    second = (first + _U(seg_len)) ^ ((h >> _U(18)) & mask)
    third = (first + _U(2 * seg_len)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter over the distinct 64-bit `keys`, as bytes."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return struct.pack(_HEAD, 0, 0, 0, 0)
    seg_len = 4 if n < 2 else 2 ** max(2, int(math.log(n) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    seg_count = max(1, math.ceil(n * factor / seg_len) - 2)
    size = (seg_count + 2) * seg_len
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        slots = _slots(h, seg_len, seg_count)
        waves = _peel(slots, n, size)
        if waves is not None:
            table = np.zeros(size, np.uint8)
            prints = _prints(h)
            for key, slot in reversed(waves):
                a, b, c = slots[:, key]
                table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
            return struct.pack(_HEAD, seed, seg_len, seg_count, n) + table.tobytes()
    raise RuntimeError("no seed gives an acyclic assignment")


def _peel(slots: np.ndarray, n: int, size: int):
    """Waves of (keys, their own slots), or None where keys stay tangled. A slot holds the number
    and the sum of the keys that touch it, so a slot with one key names that key."""
    index = np.arange(n, dtype=np.float64)
    count = sum(np.bincount(s, minlength=size) for s in slots)
    total = sum(np.bincount(s, weights=index, minlength=size) for s in slots)
    waves, left = [], n
    while left:
        own = np.flatnonzero(count == 1)
        if not len(own):
            return None
        key, at = np.unique(total[own].astype(np.int64), return_index=True)
        waves.append((key, own[at]))
        touched = slots[:, key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(key.astype(np.float64), 3))
        left -= len(key)
    return waves


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key the filter was built on, and for about 1 in 256 of the others."""
    seed, seg_len, seg_count, n = struct.unpack_from(_HEAD, blob)
    if n == 0:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=struct.calcsize(_HEAD))
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = _slots(h, seg_len, seg_count)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)
