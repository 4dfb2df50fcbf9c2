import re

import corpus_pipeline


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if similar(sets[i], sets[j])) for i in range(len(rows))]
    return sorted(r[0] for r, at in zip(rows, label) if r[0] == min(x[0] for x, y in zip(rows, label) if y == at))


def test_dedup_stage_removes_near_copies_as_brute_force_does(spark, tmp_path):
    words = [f"w{i}" for i in range(200)]
    changed = lambda *at: " ".join("z" + w if i in at else w for i, w in enumerate(words))
    edge = [" ".join(f"e{i}" for i in range(n)) for n in (8, 9, 13)]  # 4, 5 and 9 shingles: 4 of 5 is just enough
    texts = [changed(), changed(50), changed(50, 90), changed(*range(0, 200, 3)), " ".join(words[:150]), " ".join(words[:165]), *edge, None, "", "a b", "A  b", "c", changed(10, 60, 110, 160), changed(), "q " + changed(3)]
    rows = list(enumerate(texts, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, str(tmp_path)).collect())
    assert got == kept_by_brute_force(rows) and 2 not in got and 8 not in got and 9 in got


LONG = " ".join(f"l{i}" for i in range(3000))


def mixed(spark, rows, schema="doc_id long, text string, lang string, source string, score string, row long, doc string"):
    return spark.createDataFrame([(i, t, g, "s", "mine", 1, "d") for i, t, g in rows], schema)


def kept(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "", r["score"]) for r in df.collect())


def test_dedup_of_null_and_repeated_ids(spark, tmp_path):
    """Each row is judged by itself: an id that is repeated drops no other text, and null ids are copies like others."""
    a, b, c = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    rows = [(3, a, "x"), (5, a, "x"), (5, LONG, "x"), (7, b, "x"), (7, b, "x"), (None, c, "x"), (None, c, "x"), (9, c, "x"), (None, "alone it is", "x"), (11, None, "x"), (12, "", "x")]
    got = kept(corpus_pipeline.dedup_stage(spark, mixed(spark, rows), str(tmp_path)))
    assert got == sorted([(3, a, "mine"), (5, LONG, "mine"), (7, b, "mine"), (9, c, "mine"), (-1, "alone it is", "mine"), (11, "", "mine")])


def test_decontamination_of_null_and_repeated_ids(spark, tmp_path):
    bench = spark.createDataFrame([("i1", "one two three four five six seven eight nine")], "item_id string, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = "x one two three four five six seven eight y"
    rows = [(1, hit, "x"), (1, "clean", "x"), (None, hit, "x"), (None, None, "x"), (2, LONG, "x"), (2, LONG + " " + hit, "x")]
    docs = mixed(spark, rows)
    out = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert kept(out) == sorted([(1, "clean", "mine"), (-1, "", "mine"), (2, LONG, "mine")]) and out.columns == docs.columns


def test_quality_and_language_stages(spark, tmp_path):
    good, bad = "the cat sat on the mat and looked at the sky", "BUY!! NOW!! $$$ ### NOW!! BUY!! | |"
    rows = [(i, f"{good} {i}" if i % 3 else f"{bad} {i}", "en") for i in range(400)] + [(None, f"{good} again", None), (500, None, None), (3, f"{good} more", None)]
    docs = mixed(spark, rows)
    spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    texts = [r["text"] for r in out.collect()]
    assert out.columns == docs.columns and {r["score"] for r in out.collect()} == {"mine"}
    assert not any(t and t.startswith("BUY") for t in texts) and f"{good} again" in texts and f"{good} more" in texts
    stay = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert stay.columns == docs.columns and stay.count() == len(rows) - 1  # the null text alone has no letter


def test_the_whole_pipeline_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_the_whole_pipeline_keeps_rows_of_the_stages(spark):
    """What comes out is what each stage keeps of all that the one before kept."""
    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert after.columns == docs.columns and after.exceptAll(docs).isEmpty() and 0 < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in docs.collect()) and all(r["round_trip"] for r in out)
