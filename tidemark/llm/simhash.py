"""SimHash near-duplicates, linked exactly by anchor points of a covering code.

A fingerprint has 64 bits. Two fingerprints within 3 bits agree up to one bit in one of
their 32-bit halves. The anchors of a half are the words of the perfect Hamming (31, 26)
code and one free bit: covering radius 1. A half within 1 of x is within 2 (radius plus
threshold) of the anchor next to x, so replicating each half to its 2 or 17 anchors within
2 brings every linked pair together at the home anchor of either. Comparisons happen per
anchor, of distinct fingerprints, so exact copies cost nothing.

Anchors that gather more rows than `split_above` are dealt out again by what the other half
has: of five pieces of it, two agree in every linked pair.

Null texts and texts without words have fingerprint zero and link to each other; equal
texts are one group; rows with null or repeated ids are in components like others, but a null
id names none, save a component of null ids alone; an empty table gives an empty table; other
columns are ignored. A text is held with its shingles, so a very long one takes some 25 times
its size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import spread_join, stored, table
from .textops import NONSPACE, chunks, lower, sums_by_row, words
from .xxh import xxh64_ranges

THRESHOLD = 3
SHINGLE = 3
SPLIT_ABOVE = 4096

_SMALL = 32
_LANES = np.uint64(0x0101010101010101)
_POSITION = np.arange(1, 32, dtype=np.uint64)
#: For each syndrome, the 15 pairs of positions whose flips lead to a code word.
_PAIRS = np.zeros((32, 15), np.uint64)
for _s in range(1, 32):
    _PAIRS[_s] = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < i ^ _s][:15]
_FREE = np.uint64(1 << 31)
_HALF = np.uint64(0xFFFFFFFF)
_PIECES = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))


# fingerprints


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space between words, starts, lengths, row offsets) of the k-word shingles."""
    found = words(data, offsets, NONSPACE)
    n = len(found.starts)
    begins = np.cumsum(found.lengths + 1) - found.lengths - 1
    out = np.full(int(found.lengths.sum()) + n, 0x20, np.uint8)
    out[np.arange(len(out) - n) + np.repeat(np.arange(n), found.lengths)] = data[found.inside]
    per_row = np.diff(found.rows)
    shingles = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    rows = np.concatenate([[0], np.cumsum(shingles)])
    first = np.arange(rows[-1]) - np.repeat(rows[:-1], shingles) + np.repeat(found.rows[:-1], shingles)
    last = np.minimum(first + k - 1, np.repeat(found.rows[1:], shingles) - 1)
    return out, begins[first], begins[last] + found.lengths[last] - begins[first], rows


def _majority(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per row the bits set in over half of its hashes; eight bits are counted in the bytes of one word."""
    counts = np.diff(rows)
    blocks = (counts + 254) // 255
    first = np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(rows[:-1], blocks) + (np.arange(int(blocks.sum())) - first) * 255
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    of_blocks = np.concatenate([[0], np.cumsum(blocks)])
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = sums_by_row(lanes, of_blocks) * 2 > counts[:, None]
        for byte in range(8):
            out |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprint_array(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    clean, starts, lengths, rows = _shingles(lower(data), offsets, k)
    return _majority(xxh64_ranges(clean, starts, lengths), rows)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def scan(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_array(data, offsets, k).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, fp bigint")


# links


def _half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor, whether it is the home anchor) for all anchors within 2."""
    syndrome = np.zeros(len(half), np.uint64)
    for p in _POSITION:
        syndrome ^= ((half >> (p - np.uint64(1))) & np.uint64(1)) * p
    shift = np.maximum(syndrome, np.uint64(1)) - np.uint64(1)
    home = np.where(syndrome > 0, half ^ (np.uint64(1) << shift), half)
    off = np.flatnonzero(syndrome)
    index = np.concatenate([np.arange(len(half)), np.arange(len(half)), np.repeat(off, 15)])
    anchor = np.concatenate([home, home ^ _FREE, (half[off][:, None] ^ _PAIRS[syndrome[off].astype(np.int64)]).ravel()])
    return index, anchor, np.arange(len(index)) < len(half)


def _replicate(batches):
    for batch in batches:
        fps = np.asarray(batch.column(0)).view(np.uint64)
        for which in (0, 1):
            index, anchor, home = _half_anchors((fps >> np.uint64(32 * which)) & _HALF)
            key = anchor.astype(np.int64) | (which << 32)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[index].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def _deal_out(batches):
    """Rows of crowded anchors, again by two of five pieces of the half that the anchor says nothing of."""
    for batch in batches:
        key, fps, home = (batch.column(i) for i in range(3))
        keys, values = np.asarray(key), np.asarray(fps).view(np.uint64)
        other = (values >> np.where(keys >> 32 == 0, 32, 0).astype(np.uint64)) & _HALF
        pieces = [(other >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in _PIECES]
        for number, (i, j) in enumerate(combinations(range(5), 2)):
            sub = (pieces[i] << np.uint64(7) | pieces[j]).astype(np.int64) | (number << 14)
            yield pa.RecordBatch.from_arrays([pa.array(keys << 18 | sub), fps, home], ["anchor", "fp", "home"])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= THRESHOLD


def _crowd(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per linked set within one group: as many links as fingerprints, never all pairs."""
    fps = np.unique(fps)
    label = np.arange(len(fps))
    step = max(1, (1 << 20) // len(fps))
    while True:
        new = label.copy()
        for at in range(0, len(fps), step):
            near = _close(fps[at : at + step, None], fps[None, :])
            new[at : at + step] = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return fps[label != np.arange(len(fps))], fps[label[label != np.arange(len(fps))]]
        label = new


def _compare(key: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal, adjacent keys."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
    size = np.repeat(ends - starts, ends - starts)
    a, b = [], []
    few = np.flatnonzero((size > 1) & (size <= _SMALL))
    key, values, home, width = key[few], fps[few], home[few], size[few]
    for d in range(1, int(width.max()) if len(few) else 0):
        hit = (key[d:] == key[:-d]) & (home[d:] | home[:-d]) & _close(values[d:], values[:-d])
        at = np.flatnonzero(hit)
        a.append(values[at])
        b.append(values[at + d])
    for s, e in zip(starts, ends, strict=True):
        if e - s > _SMALL:
            x, y = _crowd(fps[s:e])
            a.append(x)
            b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _per_anchor(split_above: int | None):
    """Streams rows sorted by anchor: links, and untouched rows of anchors above the bound. Only one group is held."""

    def out(a=(), b=(), anchor=None, home=None):
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(anchor, pa.int64()) if anchor is not None else pa.nulls(n, pa.int64()), pa.array(home, pa.bool_()) if home is not None else pa.nulls(n, pa.bool_())],
            ["a", "b", "anchor", "home"],
        )

    def scan(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        crowded = None  # the anchor whose rows are being passed on
        for batch in batches:
            got = (np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)))
            if crowded is not None:
                n = int(np.searchsorted(got[0], crowded, side="right"))
                if n:
                    yield out(got[1][:n], got[1][:n], got[0][:n], got[2][:n])
                    got = tuple(x[n:] for x in got)
            if not len(got[0]):
                continue
            key, fps, home = (np.concatenate([x, y]) for x, y in zip(held, got, strict=True))
            tail = int(np.searchsorted(key, key[-1]))
            if split_above:
                cuts = np.flatnonzero(np.diff(key)) + 1
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
                many = np.repeat(ends - starts > split_above, ends - starts)
                if many.any():
                    yield out(fps[many], fps[many], key[many], home[many])
                    crowded = int(key[-1]) if many[-1] else None
                    tail -= int(many[:tail].sum())
                    key, fps, home = key[~many], fps[~many], home[~many]
            yield out(*_compare(key[:tail], fps[:tail], home[:tail])) if tail else out()
            held = (key[tail:], fps[tail:], home[tail:])
        if len(held[0]):
            yield out(*_compare(*held))

    return scan


_ROWS = "anchor bigint, fp bigint, home boolean"
_FOUND = "a bigint, b bigint, anchor bigint, home boolean"


def links(fps: DataFrame, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links (a, b) that connect exactly what distances of 3 or less connect; fps has distinct values in column fp."""
    met = fps.select("fp").mapInArrow(_replicate, _ROWS).repartition("anchor").sortWithinPartitions("anchor")
    found, _ = stored(met.mapInArrow(_per_anchor(split_above), _FOUND), "anchors")
    crowded = found.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("fp"), "home")
    again = crowded.mapInArrow(_deal_out, _ROWS).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_per_anchor(None), _FOUND)
    return found.where("anchor IS NULL").select("a", "b").unionByName(again.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that links reach."""
    marks, _ = stored(fingerprints(docs, id_col, text_col, k), "fingerprints")
    distinct = marks.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(distinct, split_above))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(marks, rooted.join(named, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
