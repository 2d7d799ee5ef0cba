"""The state of a span at each line: by a window over its marks, or by mergeable summaries of offset chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _mark() -> Column:
    return F.when(F.col("kind") != "N", F.col("kind"))


def _opened() -> Column:
    return F.struct("id", "timestamp", "data", "raw_line")


def span_state(marks: DataFrame, keys: list[str], chunk: int | None = None) -> DataFrame:
    """marks with `before` (the last S or E before the row), `opens` (a START that opens) and `start` (the last START that
    opened before the row), within keys in order of byte_offset. Rows of kind N see the state and don't change it.

    Without chunk a key is one window partition. With chunk, a key is cut every so many bytes of its file, so that one used by
    half of all lines is many tasks: a chunk is reduced to its first mark, its last mark, its first START and its last START that
    follows an END; what a chunk begins with is a prefix over these summaries, of which a key has one a chunk.
    """
    if chunk is None:
        before = W.partitionBy(*keys).orderBy("byte_offset").rowsBetween(W.unboundedPreceding, -1)
        rows = marks.withColumn("before", F.last(_mark(), ignorenulls=True).over(before))
        rows = rows.withColumn("opens", (F.col("kind") == "S") & (F.coalesce("before", F.lit("E")) == "E"))
        return rows.withColumn("start", F.last(F.when(F.col("opens"), _opened()), ignorenulls=True).over(before))
    cells = [*keys, "chunk"]
    inside = W.partitionBy(*cells).orderBy("byte_offset").rowsBetween(W.unboundedPreceding, -1)
    rows = marks.withColumn("chunk", F.floor(F.col("byte_offset") / chunk))
    rows = rows.withColumn("mark_inside", F.last(_mark(), ignorenulls=True).over(inside))
    again = F.when((F.col("kind") == "S") & (F.col("mark_inside") == "E"), _opened())
    rows = rows.withColumn("start_inside", F.last(again, ignorenulls=True).over(inside))
    at = lambda held: F.when(held, F.col("byte_offset"))
    summary = rows.groupBy(*cells).agg(
        F.min_by("kind", at(F.col("kind") != "N")).alias("first_mark"), F.max_by("kind", at(F.col("kind") != "N")).alias("last_mark"),
        F.min_by(_opened(), at(F.col("kind") == "S")).alias("first_start"), F.max_by(_opened(), at(again.isNotNull())).alias("last_start"),
    )
    earlier = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("carried_mark", F.last("last_mark", ignorenulls=True).over(earlier))
    entered = F.when((F.col("first_mark") == "S") & (F.coalesce("carried_mark", F.lit("E")) == "E"), F.col("first_start"))
    summary = summary.withColumn("entered", entered).withColumn("carried_start", F.last(F.coalesce("last_start", "entered"), ignorenulls=True).over(earlier))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cells]
    rows = rows.alias("r").join(summary.select(*cells, "carried_mark", "carried_start", "entered").alias("c"), same, "left")
    rows = rows.select("r.*", "carried_mark", "carried_start", "entered").withColumn("before", F.coalesce("mark_inside", "carried_mark"))
    rows = rows.withColumn("opens", (F.col("kind") == "S") & (F.coalesce("before", F.lit("E")) == "E"))
    start = F.coalesce("start_inside", F.when(F.col("mark_inside").isNotNull(), F.col("entered")), "carried_start")
    return rows.withColumn("start", start).drop("chunk", "mark_inside", "start_inside", "carried_mark", "carried_start", "entered")
