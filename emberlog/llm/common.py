"""Helpers shared by the operators: tables, batches, folds."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.scratch import discard, scratch, shared_dir, written

__all__ = ["discard", "fold", "read", "release", "scratch", "session", "shared_dir", "small_batches", "text_bytes", "written"]

#: Rows and bytes of text in one Arrow batch; they keep a Python worker's memory small with long texts. One setting for
#: all operators, as a plan reads it when it runs.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "utf-8")) % folds


def release(spark: SparkSession) -> None:
    """Let Spark clean the shuffle files of finished jobs whose DataFrames are gone, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
