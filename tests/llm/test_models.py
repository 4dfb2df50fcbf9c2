"""The models against plain Python, with null, repeated and tied rows, clashing columns, empty tables and long texts."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import language, pieces, quality, warc
from tidemark.llm.shared import fresh_path, sampled

LANG = [(1, "der hund und die katze", "de"), (1, "the dog and the cat", "en"), (None, "le chien et le chat", "fr"), (4, None, "en"), (5, "", "de"), (6, "12 !", None), (7, "le chat", None), (1, "der hund und die katze", "de"), (8, "the " * 5000, "en"), (9, "qqq", None)]


def grams(text):
    points = [ord(c) for c in re.sub("[A-Z]", lambda m: m[0].lower(), text or "")]
    for n in language.ORDERS:
        for i in range(len(points) - n + 1):
            h = n * 0x27D4EB2F
            for j in range(n):
                h = (h ^ points[i + j]) * int(language._FACTORS[j]) & 0xFFFFFFFF
                h ^= h >> 15
            yield h % language.BUCKETS


def brute_language(rows, texts):
    counts = {}
    for _, text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(text))
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        total = {k: sum(math.log(c[g] + 0.5) - math.log(sum(c.values()) + 0.5 * language.BUCKETS) for g in grams(text)) for k, c in counts.items()}
        top = min(k for k in total if total[k] == max(total.values()))
        out.append((top, 1 / sum(math.exp(v - total[top]) for v in total.values())))
    return out


def test_language_is_that_of_brute_force(spark):
    docs = spark.createDataFrame([(*r, "x", "y") for r in LANG], "doc_id long, text string, lang string, score string, lang_pred string").repartition(2)
    rows = docs.collect()
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(LANG)
    for r, (lang, score) in zip(got, brute_language(LANG, [r["text"] for r in got])):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3)
    assert sorted(r["doc_id"] or 0 for r in got) == sorted(r["doc_id"] or 0 for r in rows)
    none = docs.where("false")
    assert language.identify(none, language.fit(none)).collect() == []
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(none)).collect()} == {"und"}


def test_junk_is_explained_by_no_language(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("der hund und die katze im haus " * 3000, "de"), ("the dog and the cat in the house " * 3000, "en")])], "doc_id long, text string, lang string")
    model = language.fit(docs)
    texts = spark.createDataFrame([(0, "the cat and the dog"), (1, "x\u4e00\u4e8cz\u4e03q\u4e94 \u516d\u516b\u4e5dw")], "doc_id long, text string")
    gain = {r["doc_id"]: r["gain"] for r in language.identify(texts, model).collect()}
    assert gain[0] > 0 > gain[1]


def tagged(n):
    good, bad = "The cat sat on the mat and looked at the sky.", "BUY!! NOW!! $$$ ### NOW!! BUY!! | | |"
    return [(i, f"{good} {i * 7919 % 1000}" if i % 3 else f"{bad} {i * 7919 % 1000}") for i in range(n)]


def test_quality_learns_from_positives_and_unlabelled(spark):
    rows = [*tagged(1800), (None, None), (5000, ""), (5000, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(1800) if i % 7 < 3] + [(None, 1), (2, None), (1, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    right = [(r["score"] >= 0.5) == bool(r["doc_id"] % 3) for r in got if r["doc_id"] is not None and r["doc_id"] < 1800]
    assert np.mean(right) > 0.99
    without = quality.fit(docs, labels.where("quality = 1 AND doc_id <> 1"))
    assert np.allclose(model.w, without.w, atol=1e-6)  # negative labels teach nothing
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.where("quality = 0"))).collect()} == {0.5}
    none = docs.where("false")
    assert quality.score(none, quality.fit(none, labels)).collect() == []


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(2, 1, 4000), rng.normal(-2, 1, 2000)
    mixed = np.sort(np.concatenate([rng.normal(2, 1, 4000), negative]))
    at = np.quantile(positive, np.linspace(0, 1, 400))
    assert quality.class_prior(positive, at, 1 - np.searchsorted(mixed, at) / len(mixed)) == pytest.approx(2 / 3, abs=0.05)


def test_samples_are_bounded_and_never_empty(spark):
    rows = spark.range(5000).selectExpr("id % 50 AS a", "id DIV 100 AS b")
    for bound in (1, 30, 400, 10_000):
        n = sampled(rows, bound).count()
        assert n <= 2 * bound and (bound < 30 or n >= min(bound, 5000) / 2)
    same = spark.range(5000).selectExpr("1 AS a")
    assert sampled(same, 10).count() <= 20 and sampled(rows.where("false"), 10).count() == 0


def test_pieces_are_reported_with_what_they_give(spark):
    texts = [(1, "Hello, World"), (1, "Hello, World"), (None, None), (2, ""), (3, "a▁b"), (4, "é😀\t"), (5, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "c", "d") for r in texts], "doc_id long, text string, ids string, decoded string")
    model = pieces.Pieces.load()
    got = pieces.report(docs, model).collect()
    assert len(got) == len(texts) and all(r["round_trip"] and r["decoded"] is None and r["n_pieces"] == len(r["ids"]) for r in got)
    back = pieces.decode(pieces.encode(docs, model), model).collect()
    assert sorted(repr(r["decoded"]) for r in back) == sorted(repr((t or "").replace("▁", " ")) for _, t in texts)
    assert pieces.report(docs.where("false"), model).collect() == []


def test_warc_of_hot_and_null_payloads(spark):
    pages = [(i, "u", "x" * 1500, "z") for i in range(60)] + [(None, "u", "x" * 1500, "z"), (70, "u", "x" * 1500, "z"), (70, None, "x" * 1500, "z")] + [(100 + i, "u", None, "z") for i in range(5)] + [(200, "u", "y" * 100_000, "z")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, digest string")
    got = warc.read_archives(warc.archive_pages(table, fresh_path(spark, "hot"))).collect()
    kinds = Counter((r["key"], r["record_type"], r["refers_to"]) for r in got)
    assert len(got) == len(pages) and all(r["problem"] is None for r in got)
    assert kinds["", "response", None] == 1 and kinds["70", "response", None] == 2 and all(kinds[str(i), "revisit", "70"] == 1 for i in range(60))
    assert warc.read_archives(warc.archive_pages(table.where("false"), fresh_path(spark, "none"))).collect() == []
