"""A training-corpus pipeline: each stage works on all that the one before kept.

1. quality: documents scored below 0.5 go.
2. language: documents without a letter, those whose language is not clear (posterior below 0.5) and those
   that no learned language explains better than chance do, per n-gram, go.
3. near_dedup: of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) one row
   stays, that with the smallest doc_id; null ids come last, and of equal ids the row that is stored first.
4. decontamination: documents in which a window of a benchmark item occurs go.
5. sentencepiece: every document is encoded, decoded and reported with its pieces.

Stages but the last return the columns of documents. Every decision is one row's own: rows with null or
repeated ids are judged by their texts and go or stay by themselves. Tables may be empty and may have more
columns, of any name; what a stage does with nulls, ties, repeated rows and very long texts is what its
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, near, pieces, quality
from tidemark.llm.shared import numbered, stored, table


def _apart(docs: DataFrame) -> DataFrame:
    """(text, doc): a row's other columns beside its text, so that no column an operator appends can clash."""
    return docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("doc"))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    return found.select("text", "doc.*").select(docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = ~language.held_out("doc_id", 3, 1)
    model = quality.fit(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return _kept(docs, quality.score(_apart(docs), model).where("score >= 0.5"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(~language.held_out("doc_id", 4, 2)))
    return _kept(docs, language.identify(_apart(docs), model).where(f"lang_pred <> '{language.UNKNOWN}' AND score >= 0.5 AND gain > 0"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(_apart(docs), "row", "documents")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")
    groups = near.near_copies(rows.select(order.alias("id"), "text"), "id")
    return _kept(docs, rows.join(groups.where("id <> component_id").select("id.row"), "row", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(_apart(docs), "row", "documents")
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), "row")
    return _kept(docs, rows.join(found.where("n_hit > 0").select(F.col("id").alias("row")), "row", "left_anti"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.report(docs, pieces.Pieces.load())


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])[0]


#: Learned models, XXH64 and the piece model are beyond SQL.
ORACLE_SQL = None
