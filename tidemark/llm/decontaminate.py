"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is 8 consecutive words of an item (an item of fewer words is one window). The
words of each window are ordered by rarity, counted over all documents. A text contains a
window only if it contains the window's rarest word, so that word is its necessary prefix:
document words are joined with prefix words alone. A match fixes where the window would
start (positional bound) and end (length bound); what is left is verified word for word and
byte for byte.

The benchmark is read in blocks of a bounded size, each broadcast and scanned for by itself;
one block serves up to `block_bytes` of item text. With more blocks the documents are stored
with a number per row, and spans and items of the blocks are merged per row: each row gets the
same result however many blocks there are, also where ids are null or repeated.

Null texts and texts without words have no hits; null items and items without words have no
windows; rows with equal item ids are one item; empty tables on either side give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, table
from .textops import ALNUM, chunks, lower, string_bytes, word_hashes, words

WINDOW = 8
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 18


class Windows:
    """The distinct windows of one block of items, as arrays for scanning."""

    def __init__(self, ids: list, texts: list[str | None], width: int):
        data, offsets = string_bytes(pa.array(texts, pa.large_string()))
        data = lower(data)
        found = words(data, offsets, ALNUM)
        hashes = word_hashes(data, found)
        numbers: dict = {}
        windows: dict[tuple, int] = {}
        self.items: list[set] = []
        first, length = [], []
        for row, item in enumerate(ids):
            a, b = int(found.rows[row]), int(found.rows[row + 1])
            number = numbers.setdefault(item, len(numbers))
            k = min(width, b - a)
            for at in range(a, b - k + 1 if k else a):
                w = windows.setdefault((k, hashes[at : at + k].tobytes()), len(windows))
                if w == len(first):
                    first.append(at)
                    length.append(k)
                    self.items.append(set())
                self.items[w].add(number)
        self.ids = pa.array(list(numbers))
        self.length = np.array(length, np.int64)
        place = np.array(first, np.int64)[:, None] + np.arange(width)
        self.real = np.arange(width)[None, :] < self.length[:, None]
        place = np.minimum(place, max(len(hashes) - 1, 0))
        self.words = np.where(self.real, hashes[place], np.uint64(0)) if len(first) else np.zeros((0, width), np.uint64)
        self.data, self.byte_starts, self.byte_lengths = data, found.starts[place] if len(first) else place, np.where(self.real, found.lengths[place], 0) if len(first) else place
        self.vocabulary = np.unique(hashes)
        counts = np.array([len(x) for x in self.items], np.int64)
        self.item_rows = np.concatenate([[0], np.cumsum(counts)])
        self.item_numbers = np.array([n for x in self.items for n in sorted(x)], np.int64)
        del self.items

    def order(self, frequency: np.ndarray) -> None:
        """Fix the prefix word and the order of verification: rarest first."""
        count = np.where(self.real, frequency[np.minimum(np.searchsorted(self.vocabulary, self.words), max(len(frequency) - 1, 0))] if len(frequency) else 0, np.iinfo(np.int64).max)
        self.by_rarity = np.argsort(count, axis=1, kind="stable")
        at = self.by_rarity[:, 0] if len(self.by_rarity) else np.zeros(0, np.int64)
        prefix = self.words[np.arange(len(at)), at]
        by_prefix = np.argsort(prefix, kind="stable")
        self.prefix, begins = np.unique(prefix[by_prefix], return_index=True)
        self.prefix_rows = np.concatenate([begins, [len(by_prefix)]])
        self.prefix_windows = by_prefix
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.prefix & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def find(self, data: np.ndarray, found, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence in a chunk; start words ascend within a window only."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        token = np.searchsorted(self.prefix, hashes[at])
        same = token < len(self.prefix)
        same[same] = self.prefix[token[same]] == hashes[at[same]]
        at, token = at[same], token[same]
        starts, windows = [], []
        many = self.prefix_rows[token + 1] - self.prefix_rows[token]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(many) // (1 << 18))) + 1, [len(at)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, w = self._verified(at[a:b], token[a:b], many[a:b], data, found, hashes)
            starts.append(s)
            windows.append(w)
        return np.concatenate(starts), np.concatenate(windows)

    def _verified(self, at, token, many, data, found, hashes):
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        window = self.prefix_windows[np.repeat(self.prefix_rows[token], many) + inner]
        position = np.repeat(at, many)
        start = position - self.by_rarity[window, 0]
        row = np.searchsorted(found.rows, position, side="right") - 1
        keep = (start >= found.rows[row]) & (start + self.length[window] <= found.rows[row + 1])
        start, window = start[keep], window[keep]
        for step in range(1, self.words.shape[1]):
            j = self.by_rarity[window, step]
            beyond = j >= self.length[window]
            keep = beyond | (hashes[np.where(beyond, start, start + j)] == self.words[window, j])
            start, window = start[keep], window[keep]
        if not len(start):
            return start, window
        real = self.real[window]
        place = (start[:, None] + np.arange(self.words.shape[1]))[real]
        theirs, n = self.byte_starts[window][real], self.byte_lengths[window][real]
        equal = found.lengths[place] == n
        owner = np.repeat(np.arange(len(start)), self.length[window])
        wrong = np.zeros(len(start), bool)
        wrong[owner[~equal]] = True
        place, theirs, n, owner = place[equal], theirs[equal], n[equal], owner[equal]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(found.starts[place], n) + inner] != self.data[np.repeat(theirs, n) + inner]
        wrong[np.repeat(owner, n)[differs]] = True
        return start[~wrong], window[~wrong]


def _frequency(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each of the block's words in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        total = np.zeros(len(known) + 1, np.int64)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[known & np.uint64((1 << _FILTER_BITS) - 1)] = True
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                data = lower(data)
                h = word_hashes(data, words(data, offsets, ALNUM))
                h = h[maybe[h & np.uint64((1 << _FILTER_BITS) - 1)]]
                at = np.searchsorted(known, h)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == h[hit]
                total += np.bincount(at[hit], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[np.asarray(rows["word"])] = np.asarray(rows["n"])
    return out


def _scan(docs: DataFrame, windows: Windows, id_type: str, item_type: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches):
        index = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                data = lower(data)
                found = words(data, offsets, ALNUM)
                start, window = index.find(data, found, word_hashes(data, found))
                row = np.searchsorted(found.rows, start, side="right") - 1
                begin, end = start - found.rows[row], start - found.rows[row] + index.length[window]
                spans = np.unique(np.stack([row, begin, end]), axis=1)
                many = index.item_rows[window + 1] - index.item_rows[window]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                items = np.unique(np.stack([np.repeat(row, many), index.item_numbers[np.repeat(index.item_rows[window], many) + inner]]), axis=1)
                rows = np.arange(part.num_rows + 1)
                span = pa.StructArray.from_arrays([pa.array(spans[1]), pa.array(spans[2])], ["s", "e"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(found.rows)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(spans[0], rows), pa.int32()), span),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(items[0], rows), pa.int32()), index.ids.take(pa.array(items[1]))),
                    ],
                    ["id", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(scan, f"id {id_type}, n_words bigint, spans array<struct<s: bigint, e: bigint>>, items array<{item_type}>")


_COVERED = """
aggregate(array_sort(spans), named_struct('to', 0L, 'n', 0L),
          (a, x) -> named_struct('to', greatest(a.to, x.e), 'n', a.n + greatest(0L, x.e - greatest(a.to, x.s))), a -> a.n)
"""


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items, spans): spans are word ranges [s, e) of matched windows, items those they come from."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = bench.select(F.col(item_col).alias("item"), F.col("text"))
    id_type, item_type = (x.schema[0].dataType.simpleString() for x in (texts, items))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        texts, _ = stored(texts.select(F.struct(F.monotonically_increasing_id().alias("row"), "id").alias("id"), "text"), "rows")
        id_type = texts.schema["id"].dataType.simpleString()
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).sort("item", "text").collect()
        windows = Windows([r["item"] for r in rows], [r["text"] for r in rows], width)
        windows.order(_frequency(texts, windows.vocabulary))
        parts.append(_scan(texts, windows, id_type, item_type))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if blocks > 1:
        merged = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name) for name in ("spans", "items")]
        found = found.groupBy(F.col("id.row").alias("row")).agg(F.first("id.id").alias("id"), F.max("n_words").alias("n_words"), *merged)
    return found.select("id", "n_words", F.expr(_COVERED).alias("n_hit"), "items", "spans")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS s
  FROM iw, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS r(i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM win
), occ AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS r(i)
), hit AS (SELECT occ.doc_id, occ.k, occ.i, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.s = win.s
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS r(p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN covered ON dw.doc_id = covered.doc_id LEFT JOIN found ON dw.doc_id = found.doc_id
"""
