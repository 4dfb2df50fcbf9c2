"""Vectorised text primitives over the UTF-8 bytes of Arrow string columns.

A chunk of rows is one byte array plus row offsets; words are runs of word bytes that
never cross a row. Chunks are bounded in bytes, so temporary arrays stay small however
long the batch is. A single text longer than the bound is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Byte classes: everything but white space; digits, a-z and all of non-ASCII.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    step = np.uint64(_MULTIPLIER)
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled += take
        step = np.uint64(int(step) * int(step) & _MASK)
    return out


_POWERS = _powers(256)


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about `limit` bytes of text each, with the bytes and row offsets."""
    data, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
    n, at = batch.num_rows, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    release()


@cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def release() -> None:
    """Give freed memory back: workers stay for later stages and would hold the most that any batch took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


@dataclass
class Words:
    starts: np.ndarray  # first byte of each word
    lengths: np.ndarray  # in bytes
    rows: np.ndarray  # index of each row's first word, and the number of words at the end
    inside: np.ndarray  # mask of word bytes


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    inside = kind[data]
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64), inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return Words(starts, lengths, np.searchsorted(starts, offsets), inside)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    """64 bits per word, the same for equal words in any chunk."""
    global _POWERS
    if not len(found.starts):
        return np.zeros(0, np.uint64)
    if (longest := int(found.lengths.max())) > len(_POWERS):
        _POWERS = _powers(longest)
    begins = np.cumsum(found.lengths) - found.lengths
    values = data[found.inside].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(values)) - np.repeat(begins, found.lengths)
    values *= _POWERS[place]
    return _mix(np.add.reduceat(values, begins) + found.lengths.astype(np.uint64))


def sums_by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values over each row's range; rows holds n + 1 offsets."""
    out = np.zeros((len(rows) - 1, *values.shape[1:]), dtype=values.dtype)
    full = rows[1:] > rows[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, rows[:-1][full], axis=0)
    return out
