"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import read, written


def normalised(text: Column) -> Column:
    """Each run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = lambda content: F.sha2(content, 256),
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    Copies are combined three times, by digest and full content each time: within an input partition (the map-side part
    of the first aggregation), within a salt, and over all salts. A salt is the input partition modulo `salts`, so a hot
    text reaches the salted merge once per partition, and the global merge at most `salts` times. Rows then meet their
    winner by digest alone; only if two contents share a digest do they meet by content too.

    Null text is the empty text. Null ids never win over others; a group of null ids only keeps null. Rows that repeat
    the smallest id of a group are all kept, so a row repeated whole stays as often as it came. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "content", "salt")
        .agg(F.min("id").alias("keep"), F.count("*").alias("n"))
    )
    winners = salted.groupBy("digest", "content").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = written(winners.select("digest", "keep_id", "group_size", F.xxhash64("content").alias("variant")), "exact-winners")
    if winners.groupBy("digest").count().where("count > 1").isEmpty():
        found = rows.select("id", "digest").join(winners.drop("variant"), "digest", "left")
    else:  # the contents of a shared digest tell the groups apart
        named = winners.alias("w").join(
            rows.select("digest", "content", F.col("id").alias("other")).alias("r"),
            (F.col("w.digest") == F.col("r.digest")) & F.col("w.keep_id").eqNullSafe(F.col("r.other")) & (F.col("w.variant") == F.xxhash64("r.content")),
        )
        named = named.select("w.*", "r.content").distinct().drop("variant")
        found = rows.join(named, ["digest", "content"], "left")
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
