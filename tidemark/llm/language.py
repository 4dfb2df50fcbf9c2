"""Language identification: multinomial naive Bayes over hashed character n-grams.

Code points (A-Z lower-cased) give n-grams of 1 to 3 characters, hashed into a fixed number
of buckets. The log-probability matrix (buckets x languages) is broadcast; a batch of texts is
a sparse matrix in row order, and its product with the matrix is a gather and a sum per text.

The model counts every document with a language; the number of languages is bounded (more
raise an error), and so is the matrix.

Null texts and texts without a letter are `und` with score 0, as is every text if nothing
could be learned; ties go to the language that sorts first; rows with a null language teach
nothing; repeated rows, and rows with null or repeated ids, count and are judged each by itself;
an empty table gives an empty table; other columns are kept. A text is held with its n-grams, so
a very long one takes some 50 times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, table
from .textops import chunks, lower, sums_by_row

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages a model may have.
LANGUAGES = 256
_SLICES = 16
SMOOTHING = 0.5
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _features(data: np.ndarray, offsets: np.ndarray):
    """For each order, (buckets, row offsets) of the n-grams inside rows."""
    points = np.frombuffer(lower(data).tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    lengths = np.diff(begins)
    for n in ORDERS:
        if len(points) < n:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        many = len(points) - n + 1
        h = np.full(many, n * 0x27D4EB2F, np.uint32)
        for i in range(n):
            h = (h ^ points[i : i + many]) * _FACTORS[i]
            h ^= h >> np.uint32(15)
        if n > 1:
            ends = begins[1:][lengths > 0]
            inside = np.ones(len(points), bool)
            for i in range(1, n):
                inside[np.maximum(ends - i, 0)] = False
            h = h[inside[:many]]
        rows = np.concatenate([[0], np.cumsum(np.maximum(lengths - n + 1, 0))])
        yield (h & np.uint32(BUCKETS - 1)).astype(np.int64), rows


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language), counted over every row with a language."""
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                names, which = np.unique(np.array(part.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
                got = np.zeros(len(names) * BUCKETS, np.int64)
                for buckets, where in _features(data, offsets):
                    got += np.bincount(np.repeat(which, np.diff(where)) * BUCKETS + buckets, minlength=len(got))
                for name, counts in zip(names, got.reshape(len(names), BUCKETS), strict=True):
                    totals[name] = totals[name] + counts if name in totals else counts
            if len(totals) > LANGUAGES:
                break
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            where = np.searchsorted(used, np.arange(_SLICES + 1) * (BUCKETS // _SLICES)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(where), pa.array(x)) for x in (used, counts[used])]
            yield pa.RecordBatch.from_arrays([pa.array([name] * _SLICES), pa.array(np.arange(_SLICES)), *lists], ["lang", "slice", "bucket", "n"])

    def total(told: pa.Table) -> pa.Table:
        bucket, n = (told.column(c).combine_chunks().flatten() for c in ("bucket", "n"))
        # sums of float64 are exact up to 2^53
        sums = np.bincount(np.asarray(bucket), np.asarray(n), BUCKETS).astype(np.int64)
        used = np.flatnonzero(sums)
        used = used if len(used) else np.zeros(1, np.int64)
        return pa.table([pa.array([told.column("lang")[0].as_py()] * len(used), pa.string()), pa.array(used), pa.array(sums[used])], names=["lang", "bucket", "n"])

    told = rows.mapInArrow(count, "lang string, slice bigint, bucket array<bigint>, n array<bigint>")
    counted, path = stored(told.groupBy("lang", "slice").applyInArrow(total, "lang string, bucket bigint, n bigint"), "languages")
    if counted.select("lang").distinct().count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found = counted.toArrow()  # at most LANGUAGES * BUCKETS rows
    discard(docs.sparkSession, path)
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        np.add.at(counts, (np.asarray(found["bucket"]), np.searchsorted(np.array(langs), np.array(found["lang"].to_pylist()))), np.asarray(found["n"]))
    weights = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BUCKETS)
    return langs, weights.astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the posterior of lang_pred under equal priors) and gain appended.

    gain is how much better, in nats per n-gram, lang_pred explains the text than chance does (all buckets
    alike): it does not grow with the length, and is below zero where no language explains the text.
    Columns of docs with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "gain")
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", lang_pred string, score double, gain double"
    text = names[kept.columns.index(text_col)]

    def score(batches):
        langs, weights = shared.value
        langs = np.array(langs, object)
        for batch in batches:
            for part, data, offsets in chunks(batch, text):
                known = np.asarray(part.column(part.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False)) & bool(len(langs))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                pred, best, gain = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if known.any():
                    total, grams = np.zeros((part.num_rows, len(langs))), np.zeros(part.num_rows)
                    for buckets, where in _features(data, offsets):
                        total += sums_by_row(weights[buckets], where)
                        grams += np.diff(where)
                    share = np.exp(total - total.max(axis=1, keepdims=True))
                    share /= share.sum(axis=1, keepdims=True)
                    pred[known], best[known] = langs[share.argmax(axis=1)][known], share.max(axis=1)[known]
                    gain[known] = (total.max(axis=1) / np.maximum(grams, 1) + np.log(BUCKETS))[known]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(best), pa.array(gain)], [*names, "lang_pred", "score", "gain"])

    marked = plain.withColumn("has_letter", F.col(text).rlike(r"\p{L}"))
    return marked.mapInArrow(score, schema).toDF(*kept.columns, "lang_pred", "score", "gain")


def held_out(id_col: str, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == remainder, F.lit(False))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
