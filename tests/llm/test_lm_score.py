import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import lm_score

TEXTS = [None, "", "!", "a b a b a b", "The the THE", "a", "x y z x y z q", "é ü é", "a b c d e f g h i j k l m"]


def rows(seed=3, n=40):
    rng = random.Random(seed)
    out = [(rng.choice([None, 1, 2, 3, 50]), t) for t in TEXTS * 2]
    return out + [(i, " ".join(rng.choice("abcdefghijklmnop") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(30)))) for i in range(n)]


def brute_force(rows, target):
    tokens = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    models, out = [], []
    for chosen in (range(len(rows)), [i for i, r in enumerate(rows) if r[0] in target]):
        word, context, pair = Counter(), Counter(), Counter()
        for i in chosen:
            for p, w in zip([None, *tokens[i]], tokens[i]):
                word[w] += 1
                context[p] += 1
                pair[p, w] += 1
        models.append((word, context, pair, sum(word.values())))
    for (key, _), ws in zip(rows, tokens):
        loss = []
        for word, context, pair, total in models:
            loss.append(sum(-math.log(0.7 * pair[p, w] / max(context[p], 1) + 0.3 * (word[w] + 1000 * models[0][0][w] / models[0][3]) / (total + 1000)) for p, w in zip([None, *ws], ws)) / max(len(ws), 1))
        out.append((key, len(ws), round(loss[1], 9), round(loss[0], 9), round(loss[1] - loss[0], 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, part, ids", [(1 << 20, 1 << 20, 10), (50, 1 << 20, 0), (1 << 20, 30, 10), (1, 1, 0)])
def test_scores_are_those_of_brute_force(spark, block, part, ids):
    """However many blocks and parts; small ones stand for a large corpus."""
    data = rows()
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, score string").repartition(3)
    target = {1, 3, 5, 7, 9, 11, 999}
    marks = spark.createDataFrame([(i,) for i in [*target, 1, None]], "doc_id long")
    got = lm_score.score(docs, marks, block_bytes=block, part_bytes=part, broadcast_ids=ids).collect()
    want = brute_force(data, target)
    clean = lambda rows: sorted([tuple(x if x is None or isinstance(x, int) else round(x, 7) + 0.0 for x in r) for r in rows], key=repr)
    assert len(got) == len(want)
    for a, b in zip(clean(got), clean(want)):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=3e-7)


def test_no_rows_and_no_target(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    none = docs.where("false").select("doc_id")
    assert lm_score.score(docs.where("false"), none).collect() == []
    assert {r["n_tokens"] for r in lm_score.score(docs, none).collect()} == {1, 2}


def test_targets_are_marked_alike_by_broadcast_and_by_shuffle(spark):
    data = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None), (1, "a")]
    texts, target = spark.createDataFrame(data, "id long, text string"), spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "id long")
    want = sorted([(1, "a", True), (1, "b", True), (2, "c", False), (None, "d", False), (3, None, True), (1, "a", True)], key=repr)
    for bound in (10, 0):
        assert sorted(map(tuple, lm_score._marked(texts, target, bound).collect()), key=repr) == want


def test_many_targets_are_never_broadcast(spark):
    """Ids above the bound times the salts took the driver's memory where Spark's estimate of them is small."""
    texts, target = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string"), spark.createDataFrame([(1,)], "id long")
    marked = lm_score._marked(texts, target, 0)
    assert len(marked.collect()) == 2
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
