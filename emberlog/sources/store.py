"""Event stores: month-partitioned Parquet, row encoding for SQL databases, cursors, open spans, retention, export."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlog.functions.fields import sorted_json
from emberlog.functions.patterns import ConfigError
from emberlog.operators.chain import EVENT
from emberlog.operators.filters import Filter
from emberlog.sources.scratch import discard, written

COLUMNS = ["id", "event_type", "name", "timestamp", "duration_ms", "parent_id", "data", "raw_line"]
#: Column types of a new SQL table for texts that are never null; as keys they are no large objects.
KEY_TYPES = "id VARCHAR(36), event_type VARCHAR(16), name VARCHAR(255)"


def with_month(events: DataFrame) -> DataFrame:
    return events.withColumn("event_month", F.date_format("timestamp", "yyyy-MM"))


def append_events(events: DataFrame, path: str) -> None:
    """Append events whose id isn't stored yet; only the months of the batch are read for that. A retried batch adds nothing."""
    _append(with_month(events.select(*COLUMNS)), path, ["id"], ["event_month"])


def append_alerts(matches: DataFrame, path: str) -> None:
    """Append matches (rule, id, timestamp) of alert rules that aren't stored yet, by rule and month."""
    _append(with_month(matches.select("rule", "id", "timestamp")), path, ["rule", "id"], ["rule", "event_month"])


def _append(rows: DataFrame, path: str, key: list[str], parts: list[str]) -> None:
    spark = rows.sparkSession
    rows = rows.dropDuplicates(key)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        stored = spark.read.schema(rows.schema).parquet(path).select(*{*key, *parts})
        months = rows.select(*parts).distinct()
        rows = rows.join(stored.join(F.broadcast(months), parts, "left_semi").select(*key), key, "left_anti")  # a row a month, and rule
    rows.write.mode("append").partitionBy(*parts).parquet(path)


def load_events(spark: SparkSession, path: str, filter_: Filter | None = None) -> DataFrame:
    return (filter_ or Filter()).apply(spark.read.schema(f"{EVENT}, event_month string").parquet(path).select(*COLUMNS))


def encode_rows(events: DataFrame) -> DataFrame:
    """For SQL databases: the payload as JSON text with sorted keys."""
    return events.select(*[sorted_json(F.col("data")).alias("data") if c == "data" else F.col(c) for c in COLUMNS])


def decode_rows(rows: DataFrame) -> DataFrame:
    """Back from encode_rows, with raw_start and raw_end of spans: cut at the first line end, both empty without one.

    A span without a duration has 0. An unknown event type is an error.
    """
    kind = F.when(F.col("event_type").isin("span", "single"), F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event type "), "event_type")))
    cut, span = F.instr("raw_line", "\n"), F.col("event_type") == "span"
    part = lambda text: F.when(span & F.col("raw_line").isNotNull(), F.when(cut > 0, F.expr(text)).otherwise(""))
    return rows.select(
        "id", kind.alias("event_type"), "name", "timestamp", F.when(span, F.coalesce("duration_ms", F.lit(0))).alias("duration_ms"), "parent_id",
        F.from_json("data", "map<string,string>").alias("data"), "raw_line",
        part("substring(raw_line, 1, instr(raw_line, '\n') - 1)").alias("raw_start"), part("substring(raw_line, instr(raw_line, '\n') + 1)").alias("raw_end"),
    )


def jdbc_options(url: str, table: str = "events", **more: str) -> dict[str, str]:
    """Options for format('jdbc') with rows of encode_rows."""
    return {"url": url, "dbtable": table, "batchsize": "5000", "isolationLevel": "READ_COMMITTED", **more}


def append_jdbc(events: DataFrame, options: dict[str, str], parts: int = 8) -> None:
    """Append events whose id isn't stored yet, making the table where there is none; only ids of the batch's time are read.

    The events are computed once, into the shared folder. The stored ids are read in parts of time, over so many connections.
    """
    rows = written(encode_rows(events).dropDuplicates(["id"]), "rows")
    save = lambda df: df.write.format("jdbc").options(createTableColumnTypes=KEY_TYPES, **options).mode("append").save()
    save(rows.limit(0))
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is not None:
        at = lambda x: F.lit(x).cast("timestamp_ntz")
        stored = _table(events.sparkSession, options, (first, last), parts).where(F.col("timestamp").between(at(first), at(last)))
        save(rows.join(stored.select("id"), "id", "left_anti").select(*COLUMNS))
    discard(rows)


def load_jdbc(spark: SparkSession, options: dict[str, str], filter_: Filter | None = None, parts: int = 8) -> DataFrame:
    """The stored events that pass a filter, read in parts of time over so many connections."""
    rows = _table(spark, options, time_bounds(spark, options), parts).withColumn("data", F.from_json("data", "map<string,string>"))
    return (filter_ or Filter()).apply(rows.select(*COLUMNS))


def time_bounds(spark: SparkSession, options: dict[str, str]) -> tuple[datetime, datetime] | None:
    """The first and last time of a SQL table, which the database finds; None if it holds no row."""
    column = _column(spark, options)
    rest = {k: v for k, v in options.items() if k != "dbtable"}
    low, high = _table(spark, {**rest, "query": f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {options['dbtable']}"}).first()
    return None if low is None else (low, high)


def _column(spark: SparkSession, options: dict[str, str]) -> str:
    """The time column's name as the database quotes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier("timestamp")


def _table(spark: SparkSession, options: dict[str, str], bounds: tuple[datetime, datetime] | None = None, parts: int = 1) -> DataFrame:
    """A SQL table; with bounds, read by so many ranges of time, a connection each. Rows before, after and without a time are in the first or last."""
    more = {"preferTimestampNTZ": "true", **options}
    if bounds is None or parts < 2 or bounds[0] == bounds[1]:
        return spark.read.format("jdbc").options(**more).load()
    cuts = [bounds[0] + (bounds[1] - bounds[0]) * k / parts for k in range(1, parts)]
    at, texts = _column(spark, options), [c.strftime("%Y-%m-%d %H:%M:%S.%f") for c in cuts]
    ranges = [f"{at} < '{texts[0]}' OR {at} IS NULL", *[f"{at} >= '{a}' AND {at} < '{b}'" for a, b in zip(texts, texts[1:])], f"{at} >= '{texts[-1]}'"]
    rest = {k: v for k, v in more.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(options["url"], options["dbtable"], predicates=ranges, properties=rest)


@dataclass(frozen=True)
class EventStore:
    """A place for events; target is the folder of a Parquet store, or the options of a SQL table."""

    kind: str
    target: str | dict[str, str]

    def append(self, events: DataFrame) -> None:
        (append_events if self.kind == "parquet" else append_jdbc)(events, self.target)

    def load(self, spark: SparkSession, filter_: Filter | None = None) -> DataFrame:
        return (load_events if self.kind == "parquet" else load_jdbc)(spark, self.target, filter_)


def open_store(config: dict[str, str]) -> EventStore:
    """The store of a configuration: type parquet with a path, or type jdbc with a url and further options."""
    rest = {k: v for k, v in config.items() if k != "type"}
    if config.get("type") == "parquet" and set(rest) == {"path"}:
        return EventStore("parquet", rest["path"])
    if config.get("type") == "jdbc" and "url" in rest:
        return EventStore("jdbc", jdbc_options(**rest))
    raise ConfigError(f"not a store: {sorted(config)} of type {config.get('type')!r}")


def latest_cursors(saves: DataFrame) -> DataFrame:
    """file_path, cursor of the last save (by seq) of each path."""
    return saves.groupBy("file_path").agg(F.max_by("cursor", "seq").alias("cursor"))


def replace_pending(stored: DataFrame, batch: DataFrame, touched: DataFrame) -> DataFrame:
    """Open spans after a save: those of the touched (file_path, parser_name) are the batch's, the others stay."""
    return stored.join(touched.select("file_path", "parser_name").distinct(), ["file_path", "parser_name"], "left_anti").unionByName(batch)


def resume(files: DataFrame, cursors: DataFrame, pending: DataFrame) -> DataFrame:
    """file_path, offset to start from: the saved cursor, at most the size, for files with an open span; else the size."""
    open_files = pending.select("file_path").distinct().withColumn("open", F.lit(True))
    rows = files.join(cursors, "file_path", "left").join(open_files, "file_path", "left")
    return rows.select("file_path", F.when(F.col("open") & F.col("cursor").isNotNull(), F.least("cursor", "size")).otherwise(F.col("size")).alias("offset"))


def known_pending(pending: DataFrame, configured: DataFrame) -> DataFrame:
    """Open spans of configured (file_path, parser_name); of one reference the latest (by seq, if there is one) counts."""
    rows = pending.join(configured, ["file_path", "parser_name"], "left_semi")
    if "seq" not in rows.columns:
        return rows
    last = F.row_number().over(W.partitionBy("file_path", "parser_name", "span_ref").orderBy(F.desc("seq")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "seq")


def retained(events: DataFrame, rules: dict[str, int], now: datetime) -> DataFrame:
    """Events younger than their parser's number of days; parsers without a rule keep all. Rules are configuration."""
    limit = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("name")] if rules else F.lit(None)
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(limit.cast("int"))
    return events.where(limit.isNull() | (F.col("timestamp") >= since))


def export_json(events: DataFrame, path: str) -> None:
    events.select(*COLUMNS).write.json(path)


def export_rows(events: DataFrame) -> DataFrame:
    """Rows of the CSV export: scalars and the payload as JSON text."""
    return encode_rows(events).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


def export_csv(events: DataFrame, path: str) -> None:
    export_rows(events).write.option("header", True).option("escape", '"').csv(path)
