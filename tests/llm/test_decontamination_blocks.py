from tidemark.llm import decontaminate


def test_blocks_keep_rows_with_null_and_repeated_ids_apart(spark):
    rows = [(None, "a b c d e f g h i j"), (None, "hello"), (None, None), (5, "hello x y"), (5, "a b c d e f g h"), (5, "clean"), (5, "clean"), (6, "hello a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i1", "a b c d e f g h i"), ("i2", "hello"), ("i3", None), ("i4", "a b c d e f g h"), ("i5", "b c d e f g h i")], "item_id string, text string")
    one, many = (sorted(map(repr, decontaminate.contamination(docs, bench, block_bytes=n).collect())) for n in (1 << 20, 8))
    assert len(one) == len(rows) and many == one
