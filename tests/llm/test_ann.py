import numpy as np
import pytest

from tidemark.llm import ann


def nearest(x, ids, own, k=10):
    d = np.sqrt(((x - x[own]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((np.arange(len(x)), ids, d)) if i != own][:k]
    return [(int(ids[i]), round(float(d[i]), 9)) for i in order]


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(table, "vec_id % 100 = 0", **options).orderBy("query_id", "rank").collect()
    out = {}
    for r in got:
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    return out


@pytest.mark.parametrize("block", [8192, 1])
def test_exact_when_all_is_probed(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[5] = x[7] = x[100]
    other = [(1000, [1.0, 2.0], "e"), (1100, [1.0, 3.0], "e"), (1101, [2.0, 2.0], "e")]  # an index of their own
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, "e"), (901, [0.0] * 8, "e"), (902, [float("nan")] * 8, "e"), (903, [None] * 8, "e"), (None, [1.0] * 8, "e"), *other]
    got = found(spark, rows, probed=1.0, shortlist=400, block_queries=block)
    assert set(got) == {0, 100, 200, 1000, 1100}
    for q in (0, 100, 200):
        assert got[q] == [(n, *r) for n, r in enumerate(nearest(x, np.arange(300), q), 1)]
    assert got[1000] == [(1, 1100, 1.0), (2, 1101, 1.0)]


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0], "e"), (0, [1.0, 1.0], "e"), (1, [1.0, 2.0], "e")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(table, "vec_id % 100 = 0").collect())
    assert got == [(1, 0, 1.0), (1, 0, 1.0), (2, 1, 1.0), (2, 1, 2.0)]
    assert ann.search(table.where("false"), "vec_id % 100 = 0").collect() == []


def test_recall_at_defaults(spark):
    """Directions without any structure, the hardest case."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = found(spark, [(i, v.tolist(), "e") for i, v in enumerate(x)])
    hits = [len({r[0] for r in nearest(x, np.arange(len(x)), q)} & {r[1] for r in got[q]}) for q in range(0, 6000, 100)]
    assert np.mean(hits) / 10 >= 0.9
