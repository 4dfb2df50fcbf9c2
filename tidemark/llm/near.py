"""Near copies by exact Jaccard similarity of five-word shingles.

Texts with equal sets of shingles are one set. What two sets of similarity s or more have to
share follows from s and their sizes alone, so sets are put aside in two steps, neither of which
moves all shingles:

1. Each set sends its head, the n - ceil(s n) + l shingles that come first by their hash, with
   l = 1 + LEAD n. Of two similar sets' heads at least l shingles are equal (l of the smaller one),
   so a set of whose head fewer are in any other head has no partner.
2. The others send all their shingles, which are ordered by the number of these sets that have
   them, rarest first. In that order similar sets share one of the larger one's first
   n - ceil(s n) + 1 and the smaller one's first n - ceil(2 s n / (1 + s)) + 1.

What is left goes to SimHash first: fingerprints of the sets are linked by anchor points, and so are,
by chains, neighbours among sets of equal least hash whose signatures of least hashes agree for the
most part; both are verified by the whole sets. That links most of a large group, but not every
similar pair, as those may be ten bits and more apart. After that groups, not sets, are candidates: two of them are if their sets share such a shingle and
may differ in as few shingles as similar sets do. How many they differ in at least is told by the shingles that no other set
has, of which every one is a difference, and by the others' parities: two sets whose numbers of shingles in a bucket are odd
and even differ there. A bucket counts for a group if all its sets agree in it. This drops no similar pair. Of a pair of groups the smaller one's sets go to the larger one's,
which all its pairs share, and are verified there. So a group of m near copies costs about m and not
m^2. Nothing is sampled and no group is cut.

Shingles are held as XXH64. Texts with fewer words than a shingle have one of all their words;
null texts and texts without words are one set; an empty table gives an empty table; equal rows
are one set and each is returned; other columns are ignored. A batch of texts is held in memory
with its shingles, so a very long text takes a small multiple of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import map_of, on_map, spread_join, stored
from .simhash import _majority, _shingles, links
from .textops import chunks, lower
from .xxh import xxh64_ranges

SIMILARITY = 0.8
SHINGLE = 5
#: Shingles beyond the first of a head that similar sets share, as a part of their size.
LEAD = 0.1
#: Sets of one shingle that are told apart in the order; above, shingles are ordered by hash.
FREQUENT = 1 << 16
#: Groups of one shingle that are paired in one task with each other or as many others; sets of a group that are in one task.
BLOCK, GROUP = 1 << 14, 1 << 10
#: Least hashes of a signature, how many of them neighbours in a chain have to agree in, and how far neighbours reach: chains only save work.
_CHAINS, _AGREED, _REACH = 16, 9, 6
_GRAMS = 1 << 20
#: Words of 64 bits of a set's parities: they tell sets of up to some 2,000 shingles apart, and larger ones the less the larger.
_WORDS = 16
#: Sets whose parities are counted at once.
_ROWS = 512

_SHARED = "gram bigint, key bigint, df bigint"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, sorted in each row and distinct; row offsets; the name of each row's set)."""
    clean, starts, lengths, rows = _shingles(lower(data), offsets, k)
    h = xxh64_ranges(clean, starts, lengths).view(np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    where = np.searchsorted(row, np.arange(len(rows)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h.view(np.uint64) + np.uint64(1)), dtype=np.uint64)])
    name = _mixed(total[where[1:]] - total[where[:-1]] + np.diff(where).astype(np.uint64))
    return h, where, name.view(np.int64)


def _least(n: np.ndarray, similarity: float) -> np.ndarray:
    """What a set of n shingles shares with a similar one; the margin keeps a product such as 0.8 * 5 from being rounded up."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def _lead(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(LEAD * n + 1e-9).astype(np.int64)


def _first_seen(seen: set, names: np.ndarray) -> np.ndarray:
    out = np.zeros(len(names), bool)
    for i, x in enumerate(names.tolist()):
        if x not in seen:
            seen.add(x)
            out[i] = True
    return out


def _heads(texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """(id, key, n, head) of texts(id, text); of equal sets in one task the first alone has its head."""

    def scan(batches):
        seen: set[int] = set()
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                h, where, name = _grams(data, offsets, k)
                n = np.diff(where)
                size = np.where(_first_seen(seen, name), np.minimum(n - _least(n, similarity) + _lead(n), n), 0)
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                head = pa.ListArray.from_arrays(pa.array(cut), pa.array(h[_ranges(where[:-1], size)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(name), pa.array(n.astype(np.int64)), head], ["id", "key", "n", "head"])

    return texts.mapInArrow(scan, f"id {texts.dtypes[0][1]}, key bigint, n bigint, head array<bigint>")


_SENT = "gram bigint, key bigint, got bigint, n bigint"


def _sent(batches):
    """What heads(key, n, head) tell each other: of a shingle that several heads here have a note (got -1) and their count
    with each set's own row (n > 0), of the others a row (got 0). So a shingle that very many sets have is few rows."""

    def out(keys, n, grams, owner):
        h, which, df = np.unique(grams, return_inverse=True, return_counts=True)
        alone = df[which] == 1
        own = np.bincount(owner[~alone], minlength=len(keys)).astype(np.int64)
        noted = h[df > 1]
        gram = np.concatenate([keys, grams[alone], noted])
        key = np.concatenate([keys, keys[owner[alone]], noted])
        got = np.concatenate([own, np.zeros(alone.sum(), np.int64), np.full(len(noted), -1)])
        size = np.concatenate([n, np.zeros(len(gram) - len(n), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key), pa.array(got), pa.array(size)], ["gram", "key", "got", "n"])

    held: list[tuple] = []
    for batch in batches:
        key, n, head = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        many = np.asarray(head.value_lengths()).astype(np.int64)
        some = many > 0
        held.append((key[some], n[some], np.asarray(head.flatten()), many[some]))
        if sum(len(x[2]) for x in held) >= _GRAMS:
            yield out(*_joined(held))
            held = []
    if held:
        yield out(*_joined(held))


def _joined(held):
    key, n, grams, many = (np.concatenate(x) for x in zip(*held, strict=True))
    return key, n, grams, np.repeat(np.arange(len(key)), many)


def _by_gram(batches):
    """Streams rows sorted by their first column, cut between its values."""
    held: list[tuple] = []
    for batch in batches:
        got = tuple(np.asarray(c) for c in batch.columns)
        if not len(got[0]):
            continue
        tail = int(np.searchsorted(got[0], got[0][-1]))
        if tail or (held and held[0][0][0] != got[0][0]):
            held.append(tuple(x[:tail] for x in got))
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append(tuple(x[tail:] for x in got))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _met(batches):
    """(key, got, n): per set how many of its shingles here are in another head. There are a few rows of a shingle per task that sent them."""
    for gram, key, got, n in _by_gram(batches):
        own = n > 0
        g, k, note = gram[~own], key[~own], got[~own] < 0
        order = np.lexsort((k, g))
        g, k, note = g[order], k[order], note[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        of = np.cumsum(new) - 1
        other = new.copy()
        other[1:] |= k[1:] != k[:-1]
        several = np.bincount(of, weights=other, minlength=int(new.sum())) > 1
        hit = several[of] & other & ~note if len(g) else note
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([key[own], k[hit]])), pa.array(np.concatenate([got[own], np.ones(int(hit.sum()), np.int64)])), pa.array(np.concatenate([n[own], np.zeros(int(hit.sum()), np.int64)]))],
            ["key", "got", "n"],
        )


def _sets(texts: DataFrame, k: int, known: np.ndarray) -> DataFrame:
    """(key, grams) of the sets that may be on the map, once per task."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def scan(batches):
        bits, seen = shared.value, set()
        for batch in batches:
            for _, data, offsets in chunks(batch, "text"):
                h, where, name = _grams(data, offsets, k)
                hit = np.flatnonzero(on_map(bits, name))
                hit = hit[_first_seen(seen, name[hit])]
                size = np.diff(where)[hit]
                cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(name[hit]), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[_ranges(where[:-1][hit], size)]))], ["key", "grams"])

    return texts.select("text").mapInArrow(scan, "key bigint, grams array<bigint>")


def _shared(batches):
    """Streams (gram, key) sorted by gram: the rows of grams that two sets or more have, with their number up to FREQUENT."""

    def out(gram, key, df):
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(key), pa.array(df)], ["gram", "key", "df"])

    held, passing = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    for batch in batches:
        gram, key = (np.concatenate(x) for x in zip(held, (np.asarray(c) for c in batch.columns), strict=True))
        if not len(gram):
            continue
        cuts = np.flatnonzero(np.diff(gram)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(gram)]])
        df = np.repeat(np.minimum(ends - starts, FREQUENT), ends - starts)
        if passing is not None:
            df[gram == passing] = FREQUENT
        tail = int(starts[-1])
        if len(gram) - tail >= FREQUENT or passing == gram[-1]:
            passing, tail = int(gram[-1]), len(gram)
        many = df[:tail] > 1
        yield out(gram[:tail][many], key[:tail][many], df[:tail][many])
        held = gram[tail:], key[tail:]
    if len(held[0]) > 1:
        yield out(*held, np.full(len(held[0]), len(held[0])))


def _neighbours(batches):
    """Pairs (a, b) of rows (which, least, key, signature) that are near each other with the same least hash and agree in most of the others."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        which, least, key = (np.asarray(batch.column(i)) for i in range(3))
        got = which, least, key, np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
        if last is not None:
            got = tuple(np.concatenate([x, y]) for x, y in zip(last, got, strict=True))
        last = tuple(x[-_REACH:] for x in got)
        which, least, key, signature = got
        for d in range(1, min(_REACH, len(key) - 1) + 1):
            same = (which[d:] == which[:-d]) & (least[d:] == least[:-d]) & ((signature[d:] == signature[:-d]).sum(axis=1) >= _AGREED)
            a, b = key[:-d][same], key[d:][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _fingerprints(batches):
    """(key, fp) of (key, grams)."""
    for batch in batches:
        rows = np.asarray(batch.column(1).offsets).astype(np.int64)
        h = np.asarray(batch.column(1).values).view(np.uint64)[rows[0] : rows[-1]]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_majority(h, rows - rows[0]).view(np.int64))], ["key", "fp"])


def _parities(batches):
    """(root, n, alone, p0 ...) of (root, n, grams): bit b is whether an odd number of the grams have the remainder b; alone are the shingles beside grams."""
    for whole in batches:
        for batch in (whole.slice(i, _ROWS) for i in range(0, whole.num_rows, _ROWS)):
            size = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            h = np.asarray(batch.column(2).flatten()).view(np.uint64)
            at = np.repeat(np.arange(len(size)), size) * (64 * _WORDS) + (h % np.uint64(64 * _WORDS)).astype(np.int64)
            odd = (np.bincount(at, minlength=64 * _WORDS * len(size)) & 1).astype(np.uint8)
            words = np.packbits(odd, bitorder="little").view(np.int64).reshape(len(size), _WORDS)
            alone = pa.array(np.asarray(batch.column(1)) - size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alone, *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(_WORDS)]], ["root", "n", "alone", *[f"p{i}" for i in range(_WORDS)]])


def _across(similarity: float):
    """Pairs among rows (gram, low, high, block, root, lo, hi, early, alone, odd, mixed) of groups of sets of lo to hi shingles,
    a group of (gram, low, high) at a time; early: the shingle is among those that the smaller set of a pair shares; alone: so
    many shingles at least of each set are in no other; odd, mixed: parities that are odd in all sets, and those that aren't one."""
    apart = (1 - similarity) / (1 + similarity)  # similar sets of n and m shingles differ in apart (n + m) of them at most

    def out(found):
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def pairs(block, root, lo, hi, early, alone, odd, mixed):
        side = block == block.min()
        left, right = (np.flatnonzero(side), np.flatnonzero(~side)) if not side.all() else (np.arange(len(root)), None)
        for i in left.tolist():
            j = np.arange(i + 1, len(root)) if right is None else right
            near = np.minimum(hi[j], hi[i]) >= similarity * np.maximum(lo[j], lo[i]) - 1e-9
            j = j[near & (early[j] & (lo[j] <= hi[i]) | early[i] & (lo[i] <= hi[j]))]
            differ = alone[i] + alone[j] + np.bitwise_count((odd[i] ^ odd[j]) & ~(mixed[i] | mixed[j])).sum(axis=1, dtype=np.int64)
            j = j[differ <= apart * (hi[i] + hi[j]) + 1e-6]
            if len(j):
                yield np.full(len(j), root[i]), root[j]

    def runs(batches):
        held = None
        for batch in batches:
            got = tuple(np.asarray(c.flatten()).view(np.uint64).reshape(-1, _WORDS) if pa.types.is_list(c.type) else np.asarray(c) for c in batch.columns)
            held = got if held is None else tuple(np.concatenate(x) for x in zip(held, got, strict=True))
            if not len(held[0]):
                continue
            new = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            for s, e in zip([0, *new[:-1].tolist()], new.tolist(), strict=False):
                yield tuple(x[s:e] for x in held[3:])
            if len(new):
                held = tuple(x[new[-1] :] for x in held)
        if held is not None and len(held[0]):
            yield held[3:]

    def scan(batches):
        found, size = [], 0
        for run in runs(batches):
            if len(run[0]) < 2:
                continue
            for some in pairs(*run):
                found.append(some)
                size += len(some[0])
                if size > 1 << 18:
                    yield out(found)
                    found, size = [], 0
        if found:
            yield out(found)

    return scan


def _to_centres(similarity: float):
    """Links (a, b) of rows (centre, part, other, key, n, grams), sorted by the first three: of each set of another group one to a set of the centre, if it has any."""

    class Index:
        def __init__(self, key, n, grams):
            self.key, self.n = key, n
            flat = np.concatenate(grams)
            owner = np.repeat(np.arange(len(key)), [len(x) for x in grams])
            order = np.argsort(flat, kind="stable")
            self.owner = owner[order]
            self.grams, self.starts, self.many = np.unique(flat[order], return_index=True, return_counts=True)

        def find(self, n, grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            at = at[self.grams[at] == grams]
            both = np.bincount(self.owner[_ranges(self.starts[at], self.many[at])], minlength=len(self.key))
            near = np.flatnonzero(both >= (self.n + n - both) * similarity - 1e-9)
            return self.key[near[0]] if len(near) else None

    def scan(batches):
        now, own, index = None, [], None
        for batch in batches:
            centre, part, other, key, n = (batch.column(i).to_pylist() for i in range(5))
            where, flat = np.asarray(batch.column(5).offsets), np.asarray(batch.column(5).values)
            a, b = [], []
            for i in range(batch.num_rows):
                grams = flat[where[i] : where[i + 1]]
                if (centre[i], part[i]) != now:
                    now, own, index = (centre[i], part[i]), [], None
                if not other[i]:
                    own.append((key[i], n[i], grams.copy()))
                    continue
                if index is None and own:
                    index = Index(*(np.array(x) if j < 2 else x for j, x in enumerate(zip(*own, strict=True))))
                if own and (found := index.find(n[i], grams)) is not None:
                    a.append(key[i])
                    b.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return scan


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(id, component_id): component_id is the smallest id that pairs of `similarity` or more reach. docs is read twice."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks, _ = stored(_heads(texts, k, similarity), "heads")
    met = marks.select("key", "n", "head").mapInArrow(_sent, _SENT).repartition("gram").sortWithinPartitions("gram").mapInArrow(_met, "key bigint, got bigint, n bigint")
    least = F.ceil(F.col("n") * F.lit(similarity) - 1e-9)
    need = 1 + F.floor(least * F.lit(LEAD) + 1e-9)  # a partner may be as small as `least`
    left, _ = stored(met.groupBy("key").agg(F.sum("got").alias("got"), F.max("n").alias("n")).where(F.col("got") >= need).select("key", "n"), "left")

    sets = _sets(texts, k, map_of(left)).groupBy("key").agg(F.first("grams").alias("grams")).join(left, "key", "left_semi")
    each = sets.select("key", F.explode("grams").alias("gram")).select("gram", "key").repartition("gram").sortWithinPartitions("gram")
    shared, _ = stored(each.mapInArrow(_shared, _SHARED), "shared")
    # grams of one set only come first in the order, so the rest of a head is as much shorter
    inner = F.ceil(F.col("n") * F.lit(2 * similarity / (1 + similarity)) - 1e-9)
    own = shared.groupBy("key").agg(F.count("*").alias("common")).join(left, "key").where(F.col("common") >= least)
    own = own.select("key", "n", (F.col("common") - least + 1).cast("int").alias("head"), (F.col("common") - inner + 1).cast("int").alias("early"))
    sorted_sets = shared.join(own, "key").groupBy("key", "n", "head", "early").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    kept, _ = stored(sorted_sets.select("key", "n", "head", "early", F.col("grams.gram").alias("grams")), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        first = kept.select(F.col("key").alias("a"), "n", F.col("grams").alias("x"))
        second = kept.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("grams").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(first, "a").join(second, "b").where(both >= (F.col("n") + F.col("m") - both) * F.lit(similarity) - 1e-9).select("a", "b")

    signature = F.array(*[F.array_min(F.transform("grams", lambda g, i=i: F.xxhash64(g, F.lit(i)))) for i in range(_CHAINS)])
    chain = kept.select("key", signature.alias("signature")).select("key", "signature", F.posexplode("signature").alias("which", "least"))
    # neighbours are sets that share one more least hash, or in every other chain any
    beside = F.when(F.col("which") % 2 == 0, F.element_at("signature", (F.col("which") + 1) % _CHAINS + 1)).otherwise(0)
    chain = chain.withColumns({"beside": beside, "place": F.xxhash64("key", "which")})
    chain = chain.repartitionByRange("which", "least", "beside", "place").sortWithinPartitions("which", "least", "beside", "place").select("which", "least", "key", "signature")
    prints, _ = stored(kept.select("key", "grams").mapInArrow(_fingerprints, "key bigint, fp bigint"), "prints")
    first = prints.groupBy("fp").agg(F.min("key").alias("first"))
    linked = links(first).join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    alike = prints.join(first, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    proposed = chain.mapInArrow(_neighbours, "a bigint, b bigint").unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b"))).unionByName(alike)
    chained, _ = stored(verified(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "chained")
    roots = components(chained).select(F.col("node").alias("key"), "root")

    members, _ = stored(kept.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")), "members")
    words = [f"p{i}" for i in range(_WORDS)]
    marked = members.select("root", "n", "grams").mapInArrow(_parities, ", ".join(f"{x} bigint" for x in ["root", "n", "alone", *words]))
    both = [(F.bit_and(x), F.bit_or(x)) for x in words]
    agreed = F.array(*[x for x, _ in both]).alias("odd"), F.array(*[x.bitwiseXOR(y) for x, y in both]).alias("mixed")
    groups, _ = stored(marked.groupBy("root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("size"), F.min("alone").alias("alone"), *agreed), "groups")
    heads = members.select("root", "early", F.posexplode(F.slice("grams", F.lit(1), F.col("head"))).alias("place", "gram"))
    heads = heads.groupBy("root", "gram").agg(F.max(F.col("place") < F.col("early")).alias("early"))
    several = heads.groupBy("gram").agg(F.count("*").alias("count"), F.max("early").alias("any")).where("any AND count > 1").select("gram", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = heads.join(several, "gram").join(groups, "root")
    dealt = dealt.withColumn("block", F.pmod("root", F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("gram", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "root", "lo", "hi", "early", "alone", "odd", "mixed")
    dealt = dealt.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    pairs = dealt.mapInArrow(_across(similarity), "a bigint, b bigint").distinct()

    size = lambda x: groups.select(F.col("root").alias(x), F.struct("size", "root").alias(f"of_{x}"))
    pairs = pairs.join(size("a"), "a").join(size("b"), "b").select(F.greatest("of_a", "of_b").alias("large"), F.least("of_a", "of_b").alias("small"))
    pairs, _ = stored(pairs.select(F.col("large.root").alias("centre"), F.ceil(F.col("large.size") / group).cast("int").alias("parts"), F.col("small.root").alias("root")), "pairs")
    centres = pairs.select("centre", "parts").distinct()
    own = members.join(centres, F.col("root") == F.col("centre")).select("centre", F.pmod("key", F.col("parts")).cast("int").alias("part"), F.lit(False).alias("other"), "key", "n", "grams")
    others = members.join(pairs, "root").select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("other"), "key", "n", "grams")
    gathered = own.unionByName(others).repartition("centre", "part").sortWithinPartitions("centre", "part", "other")
    found = components(chained.unionByName(gathered.mapInArrow(_to_centres(similarity), "a bigint, b bigint")))

    named = marks.groupBy("key").agg(F.min("id").alias("least")).join(found.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(marks.select("id", "key"), named.join(best, "root").select("key", "component_id"), "key").select("id", "component_id")
