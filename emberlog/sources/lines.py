"""Lines of text files with their exact byte offsets, and lines made from the events table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlog.sources.tail import PIECE_BYTES, RangeSource


def read_lines(spark: SparkSession, paths: str | list[str], piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """file_path, byte_offset, line of all files of some globs; a line ends with \\n or \\r\\n. One narrow scan of byte ranges.

    The paths are local ones or addresses that pyarrow.fs opens; text_lines reads what Spark alone can open.
    """
    spark.dataSource.register(RangeSource)
    return spark.read.format("loglines").option("path", json.dumps([paths] if isinstance(paths, str) else paths)).option("piece_bytes", piece_bytes).load()


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same by Spark's own text source, for any path that it reads; all lines are shuffled.

    Offsets are sums within a split plus the totals of the file's earlier splits, of which there are few.
    """
    raw = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("at", F.monotonically_increasing_id()).withColumn("bytes", F.octet_length("value") + 1)
    blocks = raw.groupBy("file_path", "block").agg(F.sum("bytes").alias("total"))
    earlier = F.coalesce(F.sum("total").over(W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file_path", "block", earlier.alias("start"))
    inside = F.coalesce(F.sum("bytes").over(W.partitionBy("file_path", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = raw.withColumn("inside", inside).join(starts, ["file_path", "block"])
    return rows.select("file_path", (F.col("start") + F.col("inside")).alias("byte_offset"), F.regexp_replace("value", "\r$", "").alias("line"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of four applications written from the events table: LOG, START, END and NOTE lines in event order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at, user = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("user_id").cast("string"), 6, "0")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    line = (
        F.when(F.col("event_type") == "click", text(at, " U", user, "   START op=op", (F.col("event_id") % 3).cast("string")))
        .when(F.col("event_type") == "purchase", text(at, " U", user, "   END status=", F.when(F.col("event_id") % 7 == 0, "500").otherwise("200")))
        .when(F.col("event_type") == "view", text(at, " U", user, " NOTE k=", F.get_json_object("props", "$.k")))
        .when(F.col("event_type") == "error", text(at, " LOG level=ERROR cents=", cents))
        .otherwise(text(at, " LOG level=INFO cents=", cents))
    )
    return e.select(text("app-", (F.col("user_id") % 4).cast("string"), ".log").alias("file_path"), F.col("event_id").alias("byte_offset"), line.alias("line"))
