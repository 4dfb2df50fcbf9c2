import random

import pytest

from tidemark.llm import near


def brute_force(texts, similarity=0.8, k=2):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    label = list(range(len(sets)))
    alike = lambda a, b: a == b or len(a & b) >= similarity * len(a | b) - 1e-9
    links = [[j for j in range(len(sets)) if alike(sets[i], sets[j])] for i in range(len(sets))]
    for _ in sets:
        new = [min(label[j] for j in row) for row in links]
        if new == label:
            break
        label = new
    return dict(enumerate(label))


def varied(rng, n):
    """Texts around the limit: groups of near copies, chains of them, shared passages, exact copies, nulls and short ones."""
    passage, out = [f"p{i}" for i in range(12)], [None, "", "a", "a", "a b", "b a", " a  b "]
    for g in range(n):
        base = [f"{g}w{rng.randrange(40)}" for _ in range(rng.choice([6, 12, 25, 40]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 9])):
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = f"x{rng.randrange(300)}"
            out += [" ".join(base)] * rng.choice([1, 1, 3])
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed, block", [(1, 1 << 14), (2, 2)])
def test_near_copies_are_those_of_brute_force(spark, seed, block, monkeypatch):
    texts = varied(random.Random(seed), 25)
    if block == 2:
        monkeypatch.setattr(near, "_AGREED", 17)  # no chains
        monkeypatch.setattr(near, "links", lambda fps: fps.select("fp", "fp").toDF("a", "b").where("false"))  # nor links of fingerprints
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in near.near_copies(docs, k=2, block=block, group=block).collect()}
    assert got == brute_force(texts)


def test_near_copies_of_nothing(spark):
    assert near.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_that_differ_too_much_are_no_candidates(spark, monkeypatch):
    """Copies of one text that are too far apart share its shingles pair by pair; only pairs that may be similar become rows."""
    rng, base = random.Random(4), [f"w{i}" for i in range(140)]
    texts = [" ".join(rng.choice("xyz") + w if rng.random() < 0.12 else w for w in base) for _ in range(120)] + [" ".join(base), " ".join(["q", *base])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows, stored = {}, near.stored

    def counted(df, name):
        found = stored(df, name)
        rows[name] = found[0].count()
        return found

    monkeypatch.setattr(near, "stored", counted)
    got = {r["id"]: r["component_id"] for r in near.near_copies(docs, k=2).collect()}
    assert got == brute_force(texts)
    assert rows["groups"] > 100 and rows["pairs"] < rows["groups"]
