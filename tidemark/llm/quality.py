"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled documents share one linear scorer g over byte and word
statistics of the whole text. With the logistic loss l and an estimated class prior p, the
minimised risk is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]); where the second term would
go negative, the step is taken back. The prior is estimated from positives and unlabelled
documents alone, and the score is the logistic function of g: no negative label is used.

At most about `sample` positives are taken, chosen by a hash; every document is unlabelled data,
read once to store its statistics and then in each step; scoring covers every document.

Null and empty texts have statistics of zero and are scored like any other; without a
positive label every score is 0.5; rows with a null label or id are no positives; of several
labels of one id the smallest counts; equal rows count, and are scored, each; an empty table
gives an empty table; other columns are kept. A text is held with its words, so a very long one
takes some 30 times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .shared import discard, sampled, stored, table
from .textops import NONSPACE, chunks, sums_by_row, word_hashes, words

SAMPLE = 20_000
STEPS = 14
DECAY = 0.1
_THRESHOLDS = 400
#: Chance that the positives' share above a threshold is further off than the prior's estimate allows for.
CONFIDENCE = 0.1
_ASCII = 128
WIDTH = _ASCII + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH statistics per text."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    counts = np.bincount(row * _ASCII + np.minimum(data, _ASCII - 1), minlength=n * _ASCII).reshape(n, _ASCII)
    found = words(data, offsets, NONSPACE)
    h = word_hashes(data, found)
    many = np.diff(found.rows)
    per_word = np.maximum(many, 1)[:, None]
    owner = np.repeat(np.arange(n), many)
    stats = np.zeros((len(h), 5))
    for i, gap in enumerate((1, 2)):
        if len(h) > gap:
            stats[gap:, i] = (h[gap:] == h[:-gap]) & (owner[gap:] == owner[:-gap])
    stats[:, 2] = found.lengths <= 3
    stats[:, 3] = found.lengths > 12
    stats[:, 4] = np.minimum(found.lengths, 100) / 10
    stats = sums_by_row(stats, found.rows) / per_word
    first = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)[0].astype(np.int64)
    distinct = np.bincount(first, minlength=n) / per_word[:, 0]
    upper = counts[:, 65:91].sum(axis=1) / np.maximum(lengths, 1)
    shares = np.sqrt(counts / np.maximum(lengths, 1)[:, None])
    return np.column_stack([shares, stats, distinct, upper, np.log1p(lengths) / 10]).astype(np.float32)


class Model:
    def __init__(self, mean, scale, w):
        self.mean, self.scale, self.w = mean, scale, w

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Standardised statistics and a constant."""
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.standard(x) @ self.w, -50, 50)))


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over all rows of `partial`, which gives `size` figures for a matrix of statistics; one row per figure reaches the driver."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, WIDTH)
            if len(x):
                total += partial(x)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["i", "v"])

    got = rows.select("x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[np.asarray(got["i"])] = np.asarray(got["v"])
    return out


def class_prior(positive: np.ndarray, at: np.ndarray, above: np.ndarray) -> float:
    """The share of positives among unlabelled documents, from both sides' shares above thresholds `at` of one ranking.

    Above a threshold that only positives reach, the unlabelled share is the prior times the positives' share; elsewhere
    more. So the least ratio is the prior, taken where the positives' share is known well enough.
    """
    own = 1 - np.searchsorted(np.sort(positive), at) / len(positive)
    slack = np.sqrt(np.log(4 / CONFIDENCE) / (2 * len(positive)))
    sure = own > 0
    best = np.argmin((above[sure] + slack) / own[sure])
    return float(np.clip(above[sure][best] / own[sure][best], 0.01, 0.99))


def fit_nnpu(model: Model, positive: np.ndarray, unlabelled: DataFrame, n: int, prior: float) -> None:
    """Set the weights by Newton's steps on the non-negative risk, each over all unlabelled rows (x).

    With the logistic loss l, l(g) - l(-g) = -g, so positives enter the unclipped risk by their mean alone. A step that makes
    the unlabelled part negative, or the risk larger, is halved: the ascent of the clipped term ends where it is not negative.
    """
    p = model.standard(positive)
    d = p.shape[1]
    w = np.zeros(d)
    w[-1] = np.log(prior / (1 - prior))
    old, step, risk_before = w, None, np.inf

    def sums(w):
        def partial(x):
            z = model.standard(x)
            g = np.clip(z @ w, -50, 50)
            s = 1 / (1 + np.exp(-g))
            return np.concatenate([[np.logaddexp(0, g).sum()], z.T @ s, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])

        return _summed(unlabelled, partial, 1 + d + d * d) / n

    for _ in range(STEPS):
        got = sums(w)
        risk = got[0] - prior * (p @ w).mean() + DECAY / 2 * w @ w
        rest = got[0] - prior * np.logaddexp(0, p @ w).mean()
        if rest < 0 or risk > risk_before + 1e-12:
            step = step / 2
        else:
            model.w, old, risk_before = w, w, risk
            grad = got[1 : 1 + d] - prior * p.mean(axis=0) + DECAY * w
            step = -np.linalg.solve(got[1 + d :].reshape(d, d) + (DECAY + 1e-6) * np.eye(d), grad)
        if np.abs(step).max() < 1e-3:
            break
        w = old + step


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """docs are the unlabelled texts; of labels only the ids marked 1, the trusted positives, are used."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    trusted = sampled(marks.where("y = 1").select("id"), sample).withColumn("trusted", F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(trusted), "id", "left")  # at most 2 * `sample` ids

    def gather(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                flat = pa.array(features(data, offsets).ravel())
                x = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * WIDTH, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), x], ["trusted", "x"])

    all_, path = stored(rows.select("trusted", "text").mapInArrow(gather, "trusted boolean, x array<float>"), "statistics")
    got = sampled(all_.where("trusted").select("x"), sample).toArrow()
    positive = np.asarray(got["x"].combine_chunks().flatten() if got.num_rows else [], np.float64).reshape(-1, WIDTH)
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))
    n = all_.count()
    if len(positive):
        first = _summed(all_, lambda x: np.concatenate([x.sum(axis=0), (x * x).sum(axis=0)]), 2 * WIDTH) / n
        model.mean, model.scale = first[:WIDTH], np.sqrt(np.maximum(first[WIDTH:] - first[:WIDTH] ** 2, 0)) + 1e-3
        d = WIDTH + 1
        second = _summed(all_, lambda x: (lambda z: (z.T @ z).ravel())(model.standard(x)), d * d).reshape(d, d) / n
        centre = second[-1, :-1]
        p = model.standard(positive)
        # either half of the positives ranks, and the other, which has not seen its own part in that, is measured
        p = p[np.argsort(p @ np.random.default_rng(5).normal(size=d), kind="stable")]
        halves = [(p[::2], p[1::2]), (p[1::2], p[::2])] if len(p) > 1 else [(p, p)]
        spread = second[:-1, :-1] - np.outer(centre, centre) + np.eye(WIDTH)
        rankings = [np.append(np.linalg.solve(spread, a[:, :-1].mean(axis=0) - centre), 0) for a, _ in halves]
        own = [b @ r for (_, b), r in zip(halves, rankings, strict=True)]
        at = [np.quantile(x, np.linspace(0, 1, _THRESHOLDS)) for x in own]
        counts = lambda x: np.concatenate([len(x) - np.searchsorted(np.sort(model.standard(x) @ r), t).astype(float) for r, t in zip(rankings, at, strict=True)])
        above = _summed(all_, counts, len(at) * _THRESHOLDS).reshape(-1, _THRESHOLDS) / n
        fit_nnpu(model, positive, all_, n, float(np.mean([class_prior(*x) for x in zip(own, at, above, strict=True)])))
    discard(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with a score from 0 to 1 appended; a column of docs that is named score is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    names = [f"c{i}" for i in range(len(kept.columns))]
    plain = kept.toDF(*names)
    text = names[kept.columns.index(text_col)]

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch, text):
                got = pa.array(shared.value.score(features(data, offsets)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*part.columns, got], [*names, "score"])

    return plain.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", score double").toDF(*kept.columns, "score")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = ~held_out("doc_id", 3, 1)
    model = fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn), "doc_id", "text", "quality")
    return score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
