"""The corpus pipeline: five stages over documents, each by one of the operators.

Every stage works on all rows that the one before kept. Null, empty and very long texts, ties, repeated rows, empty tables
and clashing column names are as each stage's operator defines them; rows with null ids are scored, encoded and searched
for test items like any other, and are neither cut by nor grouped with others. Of rows that share an id all stay or all go
as near duplicates. The last stage returns the encoded documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import read, written
from emberlog.llm.decontaminate import mark_leaks
from emberlog.llm.jaccard import jaccard_groups
from emberlog.llm.line_dedup import line_dedup
from emberlog.llm.pieces import round_trip
from emberlog.llm.toxicity import score, train


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text as one, so that no name of theirs meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, with the text as it is now."""
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labels of the documents at hand."""
    model = train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return unwrapped(score(wrapped(docs), model).where("toxicity < 0.5"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document go; n_chars follows the text. No row goes."""
    found = unwrapped(line_dedup(wrapped(docs)), docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    gone = jaccard_groups(docs.select("doc_id", "text")).where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return unwrapped(wrapped(docs).join(gone, "doc_id", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return unwrapped(mark_leaks(wrapped(docs), read(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0), docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, which its encoding stands for: ids and score of the best segmentation, the next best ones as
    edits, and the decoded text's digest. Where a column of the documents has one of these names, the new one is encoded_<name>."""
    kept = [c for c in docs.columns if c not in ("text", "n_chars")]
    new = {
        "n_pieces": F.coalesce(F.size("encoded.ids"), F.lit(0)).cast("long"), "score": F.col("encoded.score"), "ids": F.col("encoded.ids"), "alternatives": F.col("encoded.alternatives"),
        "decoded_sha256": F.col("decoded_sha256"), "round_trip": F.col("round_trip"),
    }
    return round_trip(wrapped(docs)).select(*[F.col("row")[c].alias(c) for c in kept], *[x.alias(f"encoded_{c}" if c in kept else c) for c, x in new.items()])


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

#: Training, patience diff and A* search have no SQL; the rows are tested against a chain of plain Python stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's rows but the last's are written to the shared folder and read again as the next one's documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
