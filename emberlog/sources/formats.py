"""JSON-lines and logfmt ingest: every field becomes payload, without patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.fields import event_id, timestamp


def _events(lines: DataFrame, data: Column, name: str, time_format: str) -> DataFrame:
    rows = lines.withColumn("data", data).withColumn("timestamp", timestamp(F.col("data")["timestamp"], time_format)).where("timestamp is not null")
    return rows.select(
        event_id(name, F.col("file_path"), F.col("byte_offset")).alias("id"), F.lit("single").alias("event_type"), F.lit(name).alias("name"), "timestamp",
        F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("parent_id"), "data", F.col("line").alias("raw_line"),
    )


def json_events(lines: DataFrame, name: str = "json", time_format: str = "y-M-d H:m:s") -> DataFrame:
    """A line that isn't a JSON object with a valid timestamp gives no event."""
    return _events(lines, F.from_json("line", "map<string,string>"), name, time_format)


def logfmt_map(line: Column) -> Column:
    """key=value and key="quoted value" pairs; of a repeated key the last value counts."""
    pattern = r'([A-Za-z_][\w.\-]*)=("(?:[^"\\]|\\.)*"|[^\s"]*)'
    keys, values = F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.regexp_extract_all(line, F.lit(pattern), F.lit(2))
    bare = F.transform(values, lambda v: F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    pairs = F.arrays_zip(keys.alias("k"), bare.alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.transform(keys, lambda k, j: F.struct(k.alias("k"), j.alias("j"))), lambda q: (q["k"] == p["k"]) & (q["j"] > p["i"])))
    return F.map_from_arrays(F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"]))


def logfmt_events(lines: DataFrame, name: str = "logfmt", time_format: str = "y-M-d H:m:s") -> DataFrame:
    return _events(lines, logfmt_map(F.col("line")), name, time_format)
