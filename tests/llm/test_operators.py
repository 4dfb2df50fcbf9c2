import io
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import chat, components, decontaminate, language, license, lm_score, pieces, quality, simhash, textops, warc
from tidemark.llm.shared import fresh_path

TEXTS = [None, "", " ", "Hello, World hello", "a b c d e f g h i j", "Über ßen 日本 \t x", "x" * 3000 + " y", "a b c d e f g h i j"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "src0", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, score string")


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])


@pytest.mark.parametrize("limit", [1, 10, 1 << 20])
def test_words_are_those_of_a_regex(limit):
    got = []
    for _, data, offsets in textops.chunks(batch(TEXTS), "text", limit):
        data = textops.lower(data)
        w = textops.words(data, offsets, textops.ALNUM)
        got += [[data[s : s + n].tobytes().decode() for s, n in zip(w.starts[a:b], w.lengths[a:b])] for a, b in zip(w.rows[:-1], w.rows[1:])]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    assert got == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in TEXTS]


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    label = np.arange(len(ids))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(ids)).min(axis=1)
        if (new == label).all():
            return dict(zip(ids.tolist(), ids[label].tolist()))
        label = new


def test_simhash(spark):
    got = {r["id"]: r for r in simhash.near_duplicates(docs(spark)).collect()}
    want = {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == want
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(np.arange(len(TEXTS)), np.array(list(want.values()), np.uint64))
    assert simhash.near_duplicates(docs(spark).where("false")).collect() == []


def test_simhash_of_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "x y z"), (9, "A  b c d"), (None, "q r s"), (None, "q r s"), (7, None), (3, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fp = {t: fingerprint(t) for _, t in rows}
    assert sorted((repr(r["id"]), r["fp"] % (1 << 64), repr(r["component_id"])) for r in got) == sorted(
        (repr(i), fp[t], {"a b c d": "4", "A  b c d": "4", "x y z": "4", "q r s": "None", None: "3", "": "3"}[t]) for i, t in rows
    )


@pytest.mark.parametrize("split", [4096, 30])
def test_links_lose_nothing(spark, split):
    rng = np.random.default_rng(1)
    flips = np.uint64(1) << rng.integers(0, 64, (3, 600)).astype(np.uint64)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 8).astype(np.uint64)[rng.integers(0, 8, 600)] ^ flips[0] ^ flips[1] ^ flips[2], rng.integers(0, 1 << 63, 100).astype(np.uint64)])).view(np.int64)
    fps.sort()
    found = components.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), split)).collect()
    root = {r["node"]: r["root"] for r in found}
    assert {int(x): root.get(int(x), int(x)) for x in fps} == brute_components(fps, fps.view(np.uint64))


def test_decontamination(spark):
    bench = spark.createDataFrame([("i1", "a B c d e f g h i"), ("i2", "hello"), ("i3", None), ("i4", "!"), ("i1", "a b c d e f g h i")], "item_id string, text string")
    for block in (1 << 20, 12):
        got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in decontaminate.contamination(docs(spark), bench, block_bytes=block).collect()}
        assert got[4] == got[7] == (10, 9, ["i1"]) and got[3] == (3, 2, ["i2"]) and got[0] == got[1] == (0, 0, [])
    assert {r["n_hit"] for r in decontaminate.contamination(docs(spark), bench.where("false")).collect()} == {0}


def test_pieces_round_trip_and_optimum():
    model = pieces.Pieces.load()
    encode = model.encoder()
    for _, data, offsets in textops.chunks(batch([*TEXTS, "😀 \n\n  a", "é" * 70]), "text"):
        ids, rows = encode(data, offsets)
        back, where = model.decode(ids, rows)
        assert (back == data).all() and (where == offsets).all()
    text = b" strangeword"
    side, one = model.solve(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0], model._one(text)
    assert side.tolist() == one.tolist()


def test_pieces_match_the_library():
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    ours, theirs = pieces.Pieces.load(), proto.ModelProto()
    with open(pieces.MODEL_FILE, "rb") as f:
        theirs.ParseFromString(f.read())
    theirs.trainer_spec.model_type = 1
    for i, p in enumerate(theirs.pieces):
        p.score = float(ours.score[i])
    library, encode = sp.SentencePieceProcessor(model_proto=theirs.SerializeToString()), ours.encoder()
    texts = [t or "" for t in TEXTS] + ["the quick brown fox", "naïve 日本語 text 12.5"]
    for _, data, offsets in textops.chunks(batch(texts), "text"):
        ids, rows = encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])] == library.encode(texts)


def test_warc(spark):
    rows = [(1, "http://a\nb", "x" * 1200), (2, None, "x" * 1200), (None, "u", "x" * 1200), (3, "u", None), (4, "u", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["key"]: r for r in warc.read_archives(warc.archive_pages(pages, fresh_path(spark, "t"), archive_bytes=500)).collect()}
    assert len(got) == 5 and all(r["problem"] is None for r in got.values())
    assert (got["1"]["record_type"], got["1"]["refers_to"], got["1"]["payload_bytes"], got["1"]["payload"]) == ("revisit", "2", 1200, None)
    assert bytes(got["4"]["payload"]).decode() == "é" and got["3"]["payload_bytes"] == 0 and got[""]["record_type"] == "response"
    good = warc.record("1", "u", b"abc", __import__("hashlib").sha1(b"abc").digest())
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/0.9"), good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    with pytest.raises(warc.BadRecord):
        list(warc.read_archive(io.BytesIO(b"not an archive")))


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<\\|b"), (2, 0, "user", "hi"), (2, 1, "assistant", "z"), (2, 2, "user", None), (None, 0, "x\\\n<|im_end|>", "q")]
    nodes, turns = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 5 and turns.count() == 6
    stream = nodes.orderBy("start").collect()
    assert [n["start"] for n in stream] == np.cumsum([0, *[len(n["tokens"]) for n in stream]])[:-1].tolist()
    by = {n["node"]: n for n in stream}
    for n in stream:
        seen = sum(i["to"] - i["from"] for i in n["ancestors"])
        assert seen == n["position"] == (0 if not n["depth"] else by[n["parent"]]["position"] + len(by[n["parent"]]["tokens"]))
    back = {r["conv_id"]: r for r in chat.read_back(nodes, turns).collect()}
    assert back[1]["loss_chars"] == 5 and back[2]["n_turns"] == 3 and back[None]["loss_chars"] == 0
    for text in ("<|", "<\\|", "a<\\\\|b<|c", ""):
        assert chat.unescape(chat.escape(text)) == text


def test_license(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.c", "int"), ("a/b/y.c", "// Licensed under the Apache License, Version 2.0.\n"), ("c/z", None), (None, "All rights reserved."), ("top", "")]
    got = {r["path"]: r for r in license.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert (got["a/b/x.c"]["license"], got["a/b/x.c"]["licensed_by"]) == ("MIT", "a") and got["a/b/y.c"]["license"] == "Apache-2.0"
    assert got["c/z"]["license"] is None and got[None]["license"] is None and len(got) == 6


def test_models(spark):
    good, bad = "the cat sat on the mat and looked at the sky", "BUY!! NOW!! $$$ ### NOW!! BUY!!"
    table = docs(spark, [f"{good} {i}" if i % 2 else f"{bad} {i}" for i in range(200)] + [None, ""])
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200)) and 0 <= got[200] <= 1
    scored = {r["id"]: r for r in lm_score.score(table, labels.where("quality = 1")).collect()}
    assert max(scored[i]["score"] for i in range(1, 200, 2)) < min(scored[i]["score"] for i in range(0, 200, 2)) and scored[200]["n_tokens"] == 0
    named = docs(spark, ["der hund und die katze", "the dog and the cat"] * 20 + ["12 !", None]).selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS lang")
    told = {r["doc_id"]: r["lang_pred"] for r in language.identify(named, language.fit(named.where("text IS NOT NULL"))).collect()}
    assert told[0] == "de" and told[1] == "en" and told[40] == told[41] == "und"


