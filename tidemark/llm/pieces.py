"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

White space is marked as the file format asks: each space is the marker and a text begins
with one. The trie holds the marker as the byte 0x20, which no piece contains otherwise. Of
all segmentations into pieces, the one with the largest sum of log scores wins; a character
without a piece costs the lowest score less 10 and is written as its UTF-8 bytes.

Texts are cut where no piece can span: before a run of markers, and between characters whose
bytes follow each other in no piece. Each distinct stretch is solved once per batch, all of one batch side by
side in numpy; stretches of any length are solved whole.

A file of a unigram model brings log scores. A file of a byte-pair model brings merge ranks
only; then piece i of n has the log of 1 / ((i + 1) H(n)), Zipf's law over its rank.

Null and empty texts have no pieces; decoding gives the text back, save that the marker
character itself comes back as a space; of segmentations with equal sums that whose last piece
is found first stays; repeated rows, and rows with null or repeated ids, are each encoded; an
empty table gives an empty table; other columns are kept. A text is held with its pieces, so a
very long one takes some 30 times its size.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textops import Words, chunks, string_bytes, sums_by_row, word_hashes

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6
_UNIGRAM = 1
_PENALTY = 10.0
_WIDE = 64  # longer stretches are solved one by one
_TRIES = 40
_KEEP = 200_000  # solved stretches a worker remembers


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) over keys: node 0 is the root, and child c of node s is base[s] + c + 1."""
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for i, key in enumerate(keys):
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
            node = children[node][c]
        ends[node] = i
    base, check, value, used = [0], [0], [-1], bytearray(b"\x01")
    lowest, top, queue = 1, 0, [(0, 0)]
    for node, at in queue:
        value[at] = ends.get(node, -1)
        if not children[node]:
            continue
        codes = sorted(children[node])
        if (more := max(lowest, top) + 1024 - len(used)) > 0:
            base += [0] * more
            check += [-1] * more
            value += [-1] * more
            used += bytes(more)
        while used[lowest]:
            lowest += 1
        b = max(lowest - codes[0] - 1, 0)
        # first near the lowest free cell, then near the end: rather a little room than a long search
        for b in (*range(b, b + _TRIES), *range(max(top - 256, 0), top + 1)):
            if not any(used[b + c + 1] for c in codes):
                break
        base[at] = b
        for c in codes:
            used[b + c + 1], check[b + c + 1] = 1, at
            queue.append((children[node][c], b + c + 1))
        top = max(top, b + codes[-1] + 1)  # nothing is used beyond
    last = top + 260
    return tuple(np.array((x + [fill] * 260)[:last], np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A model as arrays that executors share."""

    def __init__(self, pieces: list[tuple[str, float, int]], unigram: bool):
        own = [i for i, p in enumerate(pieces) if p[2] in (_NORMAL, _USER, _UNUSED)]
        score = np.zeros(len(pieces), np.float32)
        if unigram:
            score[own] = [pieces[i][1] for i in own]
        else:
            rank = np.arange(1, len(own) + 1)
            score[own] = -np.log(rank * (1 / rank).sum())
        self.score = score
        self.unknown = np.float32(score[own].min() - _PENALTY)
        text = [p[0].replace(MARKER, " ").encode() for p in pieces]
        self.base, self.check, value = double_array([text[i] for i in own])
        self.value = np.where(value >= 0, np.array(own, np.int32)[value], -1)
        self.longest = max(len(text[i]) for i in own)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, p in enumerate(pieces):
            if p[2] == _BYTE:
                self.byte_ids[int(p[0][3:5], 16)] = i
                text[i] = bytes([int(p[0][3:5], 16)])
            elif p[2] not in (_NORMAL, _USER, _UNUSED):
                text[i] = b""
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        self.is_byte = np.isin(np.arange(len(pieces)), self.byte_ids)
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        whole = [text[i] for i in own]
        self.spans_marker = any(b" " in t.lstrip(b" ") for t in whole)
        self.apart = np.ones((256, 256), bool)  # bytes that follow each other in no piece, at a character's start
        self.apart[:, 0x80:0xC0] = False
        for t in whole:
            for pair in zip(t, t[1:]):
                self.apart[pair] = False

    @classmethod
    @cache
    def load(cls, path: str = MODEL_FILE) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == _UNIGRAM)

    def stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marked bytes, starts of stretches, index of each row's first stretch and the number of all)."""
        full = np.diff(offsets) > 0
        before = np.concatenate([[0], np.cumsum(full)])
        out = np.full(len(data) + int(before[-1]), 0x20, np.uint8)
        out[np.arange(len(data)) + np.repeat(before[1:], np.diff(offsets))] = data
        begins = offsets + before
        cut = np.zeros(len(out), bool)
        cut[1:] = self.apart[out[:-1], out[1:]]
        if not self.spans_marker:
            cut[1:] |= (out[1:] == 0x20) & (out[:-1] != 0x20)
        cut[begins[:-1][full]] = True
        starts = np.flatnonzero(cut)
        return out, starts, np.searchsorted(starts, begins)

    def solve(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of stretches, in order."""
        found: list = [None] * len(starts)
        low = 0
        for width in (8, 16, 32, _WIDE):
            part = np.flatnonzero((lengths > low) & (lengths <= width))
            for at in range(0, len(part), 20_000):
                some = part[at : at + 20_000]
                for i, ids in zip(some.tolist(), self._side_by_side(data, starts[some], lengths[some], width), strict=True):
                    found[i] = ids
            low = width
        for i in np.flatnonzero(lengths > _WIDE).tolist():
            found[i] = self._one(data[starts[i] : starts[i] + lengths[i]].tobytes())
        count = np.array([len(x) for x in found], np.int64)
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), count

    def _side_by_side(self, data, starts, lengths, width):
        n = len(starts)
        place = starts[:, None] + np.arange(width)
        text = np.where(np.arange(width) < lengths[:, None], data[np.minimum(place, len(data) - 1)], 0).T.astype(np.int64)
        best = np.full((width + 1, n), -np.inf, np.float32)
        best[0] = 0
        piece, back = np.full((width + 1, n), -1, np.int32), np.ones((width + 1, n), np.int8)
        for i in range(width):
            here = np.flatnonzero((best[i] > -np.inf) & (lengths > i))
            if not len(here):
                continue
            lead = text[i, here]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            char = np.minimum(char, lengths[here] - i)
            bare = np.zeros(n, bool)
            bare[here] = True
            chars = np.zeros(n, np.int64)
            chars[here] = char
            score, node, idx = best[i], np.zeros(len(here), np.int64), here
            for k in range(min(self.longest, width - i)):
                inside = lengths[idx] > i + k
                idx, node = idx[inside], node[inside]
                step = self.base[node] + text[i + k, idx] + 1
                ok = self.check[step] == node
                idx, node = idx[ok], step[ok].astype(np.int64)
                if not len(idx):
                    break
                value = self.value[node]
                ends = value >= 0
                to, v = idx[ends], value[ends]
                bare[to[chars[to] == k + 1]] = False
                sum_ = score[to] + self.score[v]
                better = sum_ > best[i + k + 1, to]
                to, v = to[better], v[better]
                best[i + k + 1, to], piece[i + k + 1, to], back[i + k + 1, to] = sum_[better], v, k + 1
            rest = np.flatnonzero(bare)
            for c in (1, 2, 3, 4):
                to = rest[chars[rest] == c]
                to = to[score[to] + self.unknown > best[i + c, to]] if len(to) else to
                if len(to):
                    best[i + c, to] = score[to] + self.unknown
                    for j in range(1, c + 1):
                        piece[i + j, to], back[i + j, to] = self.byte_ids[text[i + j - 1, to]], 1
        out = np.zeros((width, n), np.int32)
        count, at, live = np.zeros(n, np.int64), lengths.copy(), np.arange(n)
        while len(live):
            out[count[live], live] = piece[at[live], live]
            count[live] += 1
            at[live] -= back[at[live], live]
            live = live[at[live] > 0]
        return [out[m - 1 :: -1, i] if m == len(out) else out[:m, i][::-1] for i, m in enumerate(count.tolist())]

    def _one(self, text: bytes) -> np.ndarray:
        if not hasattr(self, "_lists"):
            self._lists = tuple(x.tolist() for x in (self.base, self.check, self.value)), [float(x) for x in self.score]
        (base, check, value), scores = self._lists
        n, unknown, f32 = len(text), float(self.unknown), np.float32
        best, piece, back = [-np.inf] * (n + 1), [0] * (n + 1), [1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            lead = text[i]
            char = min(1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4, n - i)
            node, bare = 0, True
            for k in range(i, min(n, i + self.longest)):
                step = base[node] + text[k] + 1
                if check[step] != node:
                    break
                node = step
                if (v := value[node]) >= 0:
                    bare = bare and k - i + 1 != char
                    if (s := float(f32(here + scores[v]))) > best[k + 1]:
                        best[k + 1], piece[k + 1], back[k + 1] = s, v, k + 1 - i
            if bare and (s := float(f32(here + unknown))) > best[i + char]:
                best[i + char] = s
                for j in range(1, char + 1):
                    piece[i + j], back[i + j] = int(self.byte_ids[text[i + j - 1]]), 1
        out, at = [], n
        while at:
            out.append(piece[at])
            at -= back[at]
        return np.array(out[::-1], np.int32)

    def encoder(self):
        """A function from (bytes, row offsets) to (ids, row offsets of ids) that remembers solved stretches."""
        slots: dict[int, int] = {}
        store = {"ids": np.zeros(0, np.int32), "begins": np.zeros(0, np.int64), "counts": np.zeros(0, np.int64)}

        def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out, starts, rows = self.stretches(data, offsets)
            lengths = np.diff(np.append(starts, len(out)))
            h = word_hashes(out, Words(starts, lengths, rows, np.ones(len(out), bool)))
            distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
            if len(slots) > _KEEP:
                slots.clear()
                store.update(ids=store["ids"][:0], begins=store["begins"][:0], counts=store["counts"][:0])
            names = distinct.tolist()
            slot = np.array([slots.get(x, -1) for x in names], np.int64)
            new = np.flatnonzero(slot < 0)
            if len(new):
                ids, counts = self.solve(out, starts[first[new]], lengths[first[new]])
                slot[new] = np.arange(len(new)) + len(store["counts"])
                slots.update((names[i], int(slot[i])) for i in new.tolist())
                begins = np.cumsum(counts) - counts + len(store["ids"])
                store.update(ids=np.concatenate([store["ids"], ids]), begins=np.concatenate([store["begins"], begins]), counts=np.concatenate([store["counts"], counts]))
            slot = slot[which]
            counts = store["counts"][slot]
            total = np.concatenate([[0], np.cumsum(counts)])
            inner = np.arange(int(total[-1])) - np.repeat(total[:-1], counts)
            return store["ids"][np.repeat(store["begins"][slot], counts) + inner], total[rows]

        return encode

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, row offsets); ids outside the model and control pieces are empty."""
        ids = np.where((ids >= 0) & (ids < len(self.lengths)), ids, 0)
        lengths = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        out = self.bytes[np.repeat(self.begins[ids] - total[:-1], lengths) + np.arange(int(total[-1]))]
        offsets = total[rows]
        keep = np.ones(len(out), bool)
        lead = offsets[:-1][np.diff(offsets) > 0]
        keep[lead[out[lead] == 0x20]] = False
        return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _plain(df: DataFrame, drop: str) -> tuple[DataFrame, list[str], DataFrame]:
    kept = df.drop(drop)
    names = [f"c{i}" for i in range(len(kept.columns))]
    return kept, names, kept.toDF(*names)


def _marked_spaces(part: pa.RecordBatch, index: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with the marker character as a space."""
    if MARKER.encode() not in data.tobytes():
        return data, offsets
    column = part.column(index).fill_null("")
    return string_bytes(pa.array([x.replace(MARKER, " ") for x in column.to_pylist()], pa.large_string()))


def _lists(ids: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of byte ranges; bytes that are no UTF-8 become U+FFFD."""
    try:
        data.tobytes().decode()
        text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        text.validate(full=True)
        return text
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())


def encode(docs: DataFrame, model: Pieces, text_col: str = "text") -> DataFrame:
    """docs with `ids` appended (a column of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept, names, plain = _plain(docs, "ids")
    at = kept.columns.index(text_col)

    def run(batches):
        solve = shared.value.encoder()
        for batch in batches:
            for part, data, offsets in chunks(batch, names[at]):
                ids, rows = solve(*_marked_spaces(part, at, data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids, rows)], [*names, "ids"])

    return plain.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", ids array<int>").toDF(*kept.columns, "ids")


def decode(encoded: DataFrame, model: Pieces, ids_col: str = "ids") -> DataFrame:
    """encoded with `decoded` appended (a column of that name is replaced); bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    kept, names, plain = _plain(encoded, "decoded")
    source = kept.columns.index(ids_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(source)
                ids = np.asarray(lists.flatten().fill_null(-1)).astype(np.int64)
                rows = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, _strings(*shared.value.decode(ids, rows))], [*names, "decoded"])

    return plain.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", decoded string").toDF(*kept.columns, "decoded")


def report(docs: DataFrame, model: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_pieces, n_bytes, ids_hash, round_trip, decoded): each text's encoding, read back in the same task; figures
    of it, whether decoding gives the text back, and what it gives where not."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        model = shared.value
        solve = model.encoder()
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                data, offsets = _marked_spaces(part, 1, data, offsets)
                ids, rows = solve(data, offsets)
                back, where = model.decode(ids.astype(np.int64), rows)
                same = np.diff(where) == np.diff(offsets)
                if not (same.all() and (back == data).all()):
                    same &= [back[a:b].tobytes() == data[c : c + b - a].tobytes() for a, b, c in zip(where[:-1], where[1:], offsets[:-1], strict=True)]
                decoded = pa.nulls(part.num_rows, pa.string()) if same.all() else pc.if_else(pa.array(same), None, _strings(back, where))
                n_bytes = sums_by_row(model.is_byte[ids].astype(np.int64), rows)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids, rows), pa.array(np.diff(rows)), pa.array(n_bytes), pa.array(same), decoded], _REPORT)

    found = texts.mapInArrow(run, f"id {texts.dtypes[0][1]}, ids array<int>, n_pieces bigint, n_bytes bigint, round_trip boolean, decoded string")
    return found.select(F.col("id").alias(id_col), "ids", "n_pieces", "n_bytes", F.xxhash64("ids").alias("ids_hash"), "round_trip", "decoded")


_REPORT = ["id", "ids", "n_pieces", "n_bytes", "round_trip", "decoded"]


def op5_sentencepiece(spark, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), Pieces.load(model_file))
