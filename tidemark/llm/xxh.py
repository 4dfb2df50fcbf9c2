"""XXH64 of many short byte ranges at once, in numpy; long ranges go to the xxhash library."""

from __future__ import annotations

import numpy as np
import xxhash

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_LONG = 96


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _same_length(wide: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    left = length
    if length >= 32:
        acc = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while left >= 32:
            for i in range(4):
                acc[i] = _round(acc[i], wide[at + 8 * i])
            at, left = at + 32, left - 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, np.uint64)
    h = h + np.uint64(length)
    while left >= 8:
        h = _rotl(h ^ _round(np.uint64(0), wide[at]), 27) * _P1 + _P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _rotl(h ^ ((wide[at] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at, left = at + 4, left - 4
    for i in range(left):
        h = _rotl(h ^ (data[at + i].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_ranges(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hashes of data[start : start + length] for each range."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ascontiguousarray(np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,)))
    order = np.argsort(np.minimum(lengths, _LONG).astype(np.uint8), kind="stable")
    ordered = np.minimum(lengths, _LONG)[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    with np.errstate(over="ignore"):
        for part in np.split(order, cuts):
            length = int(lengths[part[0]])
            if length < _LONG:
                out[part] = _same_length(wide, padded, starts[part], length, np.uint64(seed))
                continue
            raw = memoryview(np.ascontiguousarray(data))
            out[part] = [xxhash.xxh64_intdigest(raw[s : s + n], seed) for s, n in zip(starts[part].tolist(), lengths[part].tolist(), strict=True)]
    return out
