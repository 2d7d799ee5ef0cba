"""Lines to events as a stream: span state is carried between batches in written tables, versioned by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.config import Parser
from emberlog.operators.chain import PENDING, owned, parse_logs
from emberlog.operators.filters import Filter
from emberlog.sources.store import known_pending


def span_batches(parsers: list[Parser], events_path: str, pending_path: str, restored: DataFrame | None = None, disjoint: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. Batch n reads the open spans of batch n - 1 and overwrites its own folders, so a batch
    that is run again gives the same events and state; open spans of batches before n - 1 are deleted.

    restored: open spans that the first batch begins with; those of files and parsers that aren't configured are left out.
    disjoint: no line fits patterns of two parsers, so a batch is parsed once for its events and its open spans.
    """

    def apply(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        before = spark.read.schema(PENDING).parquet(f"{pending_path}/batch={batch - 1}") if batch else restored and known_pending(restored, configured(restored, parsers))
        parsed = parse_logs(lines, parsers, before, disjoint=disjoint)
        parsed.events.write.mode("overwrite").parquet(f"{events_path}/batch={batch}")
        parsed.pending.write.mode("overwrite").parquet(f"{pending_path}/batch={batch}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{pending_path}/batch={batch - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return apply


def configured(pending: DataFrame, parsers: list[Parser]) -> DataFrame:
    """file_path, parser_name of the open spans' files with each parser, nested ones too, that reads the file."""

    def names(parser: Parser) -> list[str]:
        return [parser.name, *(n for nested in parser.nested for n in names(nested))]

    found = F.array_compact(F.array(*[F.when(owned(p), F.lit(n)) for p in parsers for n in names(p)]))
    return pending.select("file_path").distinct().select("file_path", F.explode(F.array_distinct(found)).alias("parser_name"))


def start_ingest(lines: DataFrame, parsers: list[Parser], root: str, restored: DataFrame | None = None, disjoint: bool = False, **trigger) -> StreamingQuery:
    """Start the stream; events are in root/events, its checkpoint and open spans beside them."""
    return (
        lines.writeStream.foreachBatch(span_batches(parsers, f"{root}/events", f"{root}/pending", restored, disjoint))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def live_tail(events: DataFrame, filter_: Filter) -> DataFrame:
    """A stream of the events that pass a filter."""
    return filter_.apply(events)


def windowed_counts(events: DataFrame, by: str = "name", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts of a stream by event time; rows later than the watermark are dropped as Spark does."""
    at = F.col("timestamp").cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", lateness).groupBy(F.window("at", width), by).agg(F.count("*").alias("n"))


def burst_windows(events: DataFrame, more_than: int, minutes: int, lateness: str = "10 minutes") -> DataFrame:
    """Sliding windows of a stream of matches (with `rule`) that hold more than so many."""
    at = F.col("timestamp").cast("timestamp")
    windows = F.window("at", f"{minutes} minutes", "1 minute")
    return events.withColumn("at", at).withWatermark("at", lateness).groupBy(windows, "rule").agg(F.count("*").alias("n")).where(F.col("n") > more_than)
