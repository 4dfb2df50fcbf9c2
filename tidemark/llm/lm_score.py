"""Cross-entropy difference of two matched bigram models.

The background model counts every document, the target model every document of the target set.
Both share one vocabulary, every word of the corpus, and one smoothing: a bigram's share of its
context is interpolated with the word's share of all tokens, and that with the corpus's share of
the word, which has the weight of PRIOR tokens. A document's score is the mean over its tokens of
the target loss less the background loss: the lower, the closer to the target.

Counts are exact, grow with the corpus and are never gathered in one place. Documents are dealt
out in blocks; a block asks, once for each of its different n-grams and packed by parts of their
names, what the corpus's counts are, and tells its own; a part adds up what all blocks tell it and
answers each; with the answers a block's documents are scored. So an n-gram that a third of all
tokens are is one question per block, and no table of counts is broadcast. N-grams go by hashes
with SPARE bits more than the number of tokens has: one in 2^SPARE shares its name with another.

Null texts and texts without words have no tokens and a score of 0; without target documents the
target model is the corpus's share of words; repeated rows count as often as they occur and each
has its score, also with null or repeated ids; target ids may repeat or be missing from the
corpus; an empty table gives an empty table; other columns are ignored. A task holds a block of
texts with its n-grams, so a text longer than a block takes some 30 times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textops import ALNUM, lower, release, string_bytes, sums_by_row, word_hashes, words

#: Bytes of text of a block of documents, and of the texts whose n-grams make a part, about.
BLOCK_BYTES, PART_BYTES = 6 << 20, 6 << 20
SPARE = 24
#: Up to so many distinct target ids are broadcast; more are joined by a shuffle, once however many they are.
BROADCAST_IDS = 1_000_000
#: Parts into which the rows of each id are dealt for that shuffle, so that one id with many rows is many tasks.
SALTS = 32
#: Weight of the bigram estimate, and tokens that the corpus's share of a word counts for.
BIGRAM_WEIGHT, PRIOR = 0.7, 1000.0


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, the word before or 0, row offsets) of the tokens."""
    data = lower(data)
    found = words(data, offsets, ALNUM)
    word = np.maximum(word_hashes(data, found), np.uint64(1))
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[: len(word)]
    before[found.rows[:-1][np.diff(found.rows) > 0]] = 0
    return word, before, found.rows


def _named(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - bits)


def _names(word: np.ndarray, before: np.ndarray, bits: int) -> list[np.ndarray]:
    """Names of each token's word, context and bigram, and of the total."""
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return [_named(x, bits) for x in (word * a, before * b + np.uint64(1), before * a + word * b + np.uint64(2), np.full(1, 3, np.uint64))]


def _distinct(texts: pa.Table, bits: int):
    """(names of a block's n-grams, sorted; for words, contexts, bigrams and the total the place among them; token rows)."""
    word, before, rows = _tokens(*string_bytes(texts.column("text")))
    names = _names(word, before, bits)
    keys, place = np.unique(np.concatenate(names), return_inverse=True)
    n = len(word)
    return keys, (place[:n], place[n : 2 * n], place[2 * n : 3 * n], int(place[3 * n])), rows


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _packed(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_planes(np.ascontiguousarray(x, np.uint64)) for x in columns))


def _unpacked(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in raw]


_SENT = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])


def _ask(bits: int, parts: int):
    """A block's rows (part, block, blob): the names of its n-grams in a part, with its own counts in background and target."""
    width = -(-(1 << bits) // parts)

    def run(texts: pa.Table) -> pa.Table:
        keys, (word, context, pair, total), rows = _distinct(texts, bits)
        mine = np.repeat(np.asarray(texts.column("target").to_numpy()).astype(bool), np.diff(rows))
        counts = np.zeros((2, len(keys)), np.uint64)
        for m, some in enumerate((slice(None), mine)):
            for place in (word, context, pair):
                counts[m] += np.bincount(place[some], minlength=len(keys)).astype(np.uint64)
            counts[m, total] += np.uint64(len(word[some]))
        part = (keys // np.uint64(width)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        step = np.diff(keys, prepend=np.uint64(0))
        step[cuts[:-1]] = keys[cuts[:-1]]
        blobs = [_packed(step[a:b], *counts[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        release()
        return pa.table([pa.array(part[cuts[:-1]]), pa.array(np.full(len(blobs), texts.column("block")[0].as_py())), pa.array(blobs, pa.binary())], schema=_SENT)

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """To each blob of a part the corpus's counts of its n-grams."""
    got = [_unpacked(x, 3) for x in asked.column("blob").to_pylist()]
    ends = np.cumsum([len(x[0]) for x in got])
    keys, which = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), return_inverse=True)
    # sums of float64 are exact up to 2^53
    sums = [np.bincount(which, weights=np.concatenate([x[m] for x in got]).astype(np.float64), minlength=len(keys)).astype(np.uint64) for m in (1, 2)]
    blobs = [_packed(*[s[which[a:b]] for s in sums]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
    release()
    return pa.table([asked.column("part"), asked.column("block"), pa.chunked_array([pa.array(blobs, pa.binary())])], schema=_SENT)


_SCORED = "n_tokens bigint, loss_target double, loss_background double, score double"


def _scored(bits: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, (word, context, pair, total), rows = _distinct(texts, bits)
        order = np.argsort(np.asarray(answers.column("part")))
        blobs = answers.column("blob").to_pylist()
        counts = [np.concatenate(x).astype(np.float64) for x in zip(*[_unpacked(blobs[i], 2) for i in order], strict=True)]
        corpus = counts[0][word] / max(counts[0][total], 1)
        n = np.diff(rows)
        loss = []
        for c in counts:
            single = (c[word] + PRIOR * corpus) / (c[total] + PRIOR)
            each = -np.log(BIGRAM_WEIGHT * c[pair] / np.maximum(c[context], 1) + (1 - BIGRAM_WEIGHT) * single)
            loss.append(sums_by_row(each, rows) / np.maximum(n, 1))
        release()
        return pa.table([texts.column("id"), pa.array(n), pa.array(loss[1]), pa.array(loss[0]), pa.array(loss[1] - loss[0])], names=["id", "n_tokens", "loss_target", "loss_background", "score"])

    return run


def _marked(texts: DataFrame, target: DataFrame, broadcast_ids: int) -> DataFrame:
    """(id, text, target) of every row of texts(id, text): whether its id is among target's."""
    ids = target.where("id IS NOT NULL").distinct()
    if ids.count() <= broadcast_ids:
        found = texts.join(F.broadcast(ids.withColumn("target", F.lit(True))), "id", "left")
        return found.select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    known = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("target"))
    # null ids are no targets and have no place in the shuffle
    dealt = texts.where("id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("text", F.lit("salt")), F.lit(SALTS)).cast("int"))
    # Spark's estimate of known leaves the explode out: unhinted, SALTS times the ids would be broadcast
    found = dealt.join(known.hint("merge"), ["id", "salt"], "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    # a task that is run again has to see its rows in the same order
    return found.unionByName(texts.where("id IS NULL").select("id", "text", F.lit(False).alias("target"))).sortWithinPartitions("id", F.xxhash64("text"), "text")


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(id, n_tokens, loss_target, loss_background, score) per row of docs: mean losses in nats per token, score their difference.

    target holds, in a column of the same name, the ids of the target documents.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = _marked(texts, target.select(F.col(id_col).alias("id")), broadcast_ids)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks, parts = max(1, -(-size // block_bytes)), max(1, -(-size // part_bytes))
    bits = min(64, max(1, int(size)).bit_length() + SPARE)
    dealt = marked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    sent = "part bigint, block bigint, blob binary"
    dealt = dealt.repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(bits, parts), sent).repartition(parts, "part")
    answers = asked.groupBy("part").applyInArrow(_answer, sent).repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(bits), f"id {texts.dtypes[0][1]}, {_SCORED}")


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """The target is what labels marks as good and not toxic."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0")).withColumnRenamed("id", "doc_id")
