"""Registered queries over log lines made from the events table, with their DuckDB SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.config import load_config
from emberlog.functions.fields import short_date, sorted_json, timestamp
from emberlog.functions.patterns import spark_time_format
from emberlog.operators import alerts, filters, metrics, query, tree
from emberlog.operators.chain import EVENT, file_coverage, parse_logs, pattern_coverage
from emberlog.operators.filters import Filter
from emberlog.sources import formats, store
from emberlog.sources.lines import event_lines, read_lines
from emberlog.sources.scratch import scratch, written
from emberlog.sources.tail import LINES, TailSource
from emberlog.streaming.ingest import burst_windows, live_tail, start_ingest, windowed_counts
from emberlog.streaming.keyed import start_keyed

CONFIG = r"""
[defaults]
timestamp_format = "%Y-%m-%d %H:%M:%S"
[components]
timestamp = '\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'
ref = 'U\d{6}'
[[parsers]]
name = "app_log"
glob = "*.log"
type = "single"
pattern = '(?P<timestamp>${timestamp}) LOG level=(?P<level>\w+) cents=(?P<cents>\d+)'
[[parsers]]
name = "request"
glob = "*.log"
type = "span"
start_pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) START op=(?P<op>\w+)'
end_pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) END status=(?P<status>\d+)'
reference_fields = ["ref"]
[[parsers.nested]]
name = "note"
type = "single"
pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) NOTE k=(?P<k>\d+)'
"""
NOW = datetime(2024, 1, 25)
#: Files of a stream batch.
FILES = 4

_LINES = """lines AS (
SELECT 'app-' || CAST(user_id % 4 AS VARCHAR) || '.log' AS file_path, event_id AS byte_offset, date_trunc('second', ts) AS ts_,
  'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS ref, event_type AS t, event_id % 3 AS op, CASE WHEN event_id % 7 = 0 THEN '500' ELSE '200' END AS status,
  json_extract_string(props, '$.k') AS k, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tx,
  CASE event_type WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'E' WHEN 'view' THEN 'N' ELSE 'L' END AS kind FROM events
), line AS (SELECT *, tx || CASE kind
  WHEN 'S' THEN ' ' || ref || '   START op=op' || CAST(op AS VARCHAR) WHEN 'E' THEN ' ' || ref || '   END status=' || status
  WHEN 'N' THEN ' ' || ref || ' NOTE k=' || k ELSE ' LOG level=' || CASE WHEN t = 'error' THEN 'ERROR' ELSE 'INFO' END || ' cents=' || cents END AS line FROM lines)"""


def _uuid(name: str, at: str = "byte_offset") -> str:
    h = f"md5('{name}|' || file_path || '|' || CAST({at} AS VARCHAR))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"


_EV = f"""WITH {_LINES}, m AS (
  SELECT *, last_value(CASE WHEN kind <> 'N' THEN kind END IGNORE NULLS) OVER w AS before FROM line WHERE kind <> 'L'
  WINDOW w AS (PARTITION BY file_path, ref ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (SELECT *, kind = 'S' AND coalesce(before, 'E') = 'E' AS opens FROM m
), s AS (
  SELECT *, last_value(CASE WHEN opens THEN byte_offset END IGNORE NULLS) OVER w AS s_at, last_value(CASE WHEN opens THEN ts_ END IGNORE NULLS) OVER w AS s_ts,
    last_value(CASE WHEN opens THEN line END IGNORE NULLS) OVER w AS s_line, last_value(CASE WHEN opens THEN tx END IGNORE NULLS) OVER w AS s_tx,
    last_value(CASE WHEN opens THEN op END IGNORE NULLS) OVER w AS s_op
  FROM o WINDOW w AS (PARTITION BY file_path, ref ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), ev AS (
  SELECT {_uuid("app_log")} AS id, 'single' AS event_type, 'app_log' AS name, ts_ AS "timestamp", CAST(NULL AS BIGINT) AS duration_ms, CAST(NULL AS VARCHAR) AS parent_id,
    '{{"cents":"' || cents || '","level":"' || CASE WHEN t = 'error' THEN 'ERROR' ELSE 'INFO' END || '","timestamp":"' || tx || '"}}' AS data, line AS raw_line,
    CASE WHEN t = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, cents, NULL AS op, NULL AS status, NULL AS ref, NULL AS k, file_path, byte_offset FROM line WHERE kind = 'L'
  UNION ALL
  SELECT {_uuid("request", "s_at")}, 'span', 'request', s_ts, CAST((epoch_us(ts_) - epoch_us(s_ts)) // 1000 AS BIGINT), NULL,
    '{{"op":"op' || CAST(s_op AS VARCHAR) || '","ref":"' || ref || '","status":"' || status || '","timestamp":"' || s_tx || '"}}', s_line || chr(10) || line,
    NULL, NULL, 'op' || CAST(s_op AS VARCHAR), status, ref, NULL, file_path, byte_offset FROM s WHERE kind = 'E' AND before = 'S'
  UNION ALL
  SELECT {_uuid("note")}, 'single', 'note', ts_, NULL, {_uuid("request", "s_at")}, '{{"k":"' || k || '","ref":"' || ref || '","timestamp":"' || tx || '"}}', line,
    NULL, NULL, NULL, NULL, ref, k, file_path, byte_offset FROM s WHERE kind = 'N' AND before = 'S'
)
"""


def parsed(spark: SparkSession, sf_dir: str):
    return parse_logs(event_lines(spark, sf_dir), load_config(CONFIG))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).events


def _scalars(df: DataFrame) -> DataFrame:
    return df.select("id", "event_type", "name", "timestamp", "duration_ms", "parent_id", sorted_json(F.col("data")).alias("data"), "raw_line")


def _month_13(lines: DataFrame) -> DataFrame:
    odd = F.concat(F.substring("line", 1, 5), F.lit("13"), F.expr("substring(line, 8)"))
    return lines.withColumn("line", F.when(F.col("byte_offset") % 11 == 0, odd).otherwise(F.col("line")))


QUERIES, SQL = {}, {}


def _register(sql: str | None, common: bool = True):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (_EV if common else "") + sql
        return f

    return keep


_COLUMNS = 'id, event_type, name, "timestamp", duration_ms, parent_id, data, raw_line'


@_register("SELECT ref, date_trunc('hour', \"timestamp\") AS hour, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 3) AS p95_ms FROM ev WHERE event_type = 'span' GROUP BY ALL")
def w1_span_stats(spark, sf_dir):
    """The flagship: request spans by user and hour."""
    spans = metrics.bucketed(events(spark, sf_dir).where("event_type = 'span'"))
    return spans.groupBy(F.col("data")["ref"].alias("ref"), F.col("bucket").alias("hour")).agg(F.count("*").alias("n"), F.round(F.percentile("duration_ms", F.lit(0.95)), 3).alias("p95_ms"))


@_register("SELECT file_path, byte_offset, line FROM line")
def log_lines(spark, sf_dir):
    return event_lines(spark, sf_dir)


@_register(f"SELECT {_COLUMNS} FROM ev")
def parse_events(spark, sf_dir):
    return _scalars(events(spark, sf_dir))


@_register(f"""SELECT file_path, 'request' AS parser_name, ref, {_uuid("request", "s_at")} AS id, s_ts AS "timestamp", s_line AS raw_line FROM (
  SELECT file_path, ref, arg_max(kind, byte_offset) AS kind, max(CASE WHEN opens THEN byte_offset END) AS s_at, arg_max(ts_, CASE WHEN opens THEN byte_offset END) AS s_ts,
    arg_max(line, CASE WHEN opens THEN byte_offset END) AS s_line FROM o WHERE kind <> 'N' GROUP BY file_path, ref) WHERE kind = 'S'""")
def open_spans(spark, sf_dir):
    return parsed(spark, sf_dir).pending.select("file_path", "parser_name", F.col("span_ref")[0].alias("ref"), "id", "timestamp", "raw_line")


@_register(f"SELECT {_COLUMNS} FROM ev")
def one_pass_events(spark, sf_dir):
    """No line fits two patterns: one scan for all parsers, one window for all spans."""
    return _scalars(parse_logs(event_lines(spark, sf_dir), load_config(CONFIG), disjoint=True).events)


def _hot(sql: str) -> str:
    """All lines in one file, and half of them by one user."""
    sql = sql.replace("'app-' || CAST(user_id % 4 AS VARCHAR) || '.log' AS file_path", "'app-0.log' AS file_path")
    return sql.replace("'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS ref", "CASE WHEN event_id % 2 = 0 THEN 'U000000' ELSE 'U' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS ref")


def hot_lines(spark, sf_dir) -> DataFrame:
    line = F.when(F.col("byte_offset") % 2 == 0, F.regexp_replace("line", r"U\d{6}", "U000000")).otherwise(F.col("line"))
    return event_lines(spark, sf_dir).select(F.lit("app-0.log").alias("file_path"), "byte_offset", line.alias("line"))


@_register(_hot(_EV) + f"SELECT {_COLUMNS} FROM ev", common=False)
def hot_reference_events(spark, sf_dir):
    """One reference of one file has half of all lines; the file is cut into chunks."""
    return _scalars(parse_logs(hot_lines(spark, sf_dir), load_config(CONFIG), chunk=1000).events)


@_register("SELECT file_path, 'request' AS parser, 'duplicate start' AS reason, count(*) AS n FROM o WHERE kind = 'S' AND NOT opens GROUP BY file_path")
def diagnostics(spark, sf_dir):
    return parsed(spark, sf_dir).diagnostics


@_register("""SELECT file_path, 'app_log' AS parser, count(*) AS matched, count(*) AS claimed, CAST(0 AS BIGINT) AS shadowed FROM line WHERE kind = 'L' GROUP BY file_path
UNION ALL SELECT file_path, 'request', count(*), count(*) FILTER (opens OR (kind <> 'S' AND before = 'S')), 0 FROM o GROUP BY file_path""")
def coverage(spark, sf_dir):
    lines, parsers = event_lines(spark, sf_dir), load_config(CONFIG)
    return pattern_coverage(lines, parsers, parse_logs(lines, parsers))


@_register("""SELECT file_path, count(*) AS lines, count(*) FILTER (byte_offset % 13 = 0) AS unmatched, count(*) FILTER (byte_offset % 13 <> 0 AND byte_offset % 11 = 0) AS bad_timestamps
FROM line GROUP BY file_path""")
def unread_lines(spark, sf_dir):
    """Every thirteenth line is noise that no pattern matches, and others name a month 13."""
    lines = _month_13(event_lines(spark, sf_dir)).withColumn("line", F.when(F.col("byte_offset") % 13 == 0, "noise").otherwise(F.col("line")))
    parsers = load_config(CONFIG)
    return file_coverage(lines, parsers, parse_logs(lines, parsers))


@_register("""SELECT id, event_type AS kind, name, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS shown_at, duration_ms FROM ev""")
def viewer_rows(spark, sf_dir):
    return query.rows_view(events(spark, sf_dir))


@_register("""SELECT id, replace(raw_line, chr(10), ' - ') AS raw, CAST(generate_subscripts(ks, 1) - 1 AS INTEGER) AS position, unnest(ks) AS key, json_extract_string(data, '$.' || unnest(ks)) AS value
FROM (SELECT *, json_keys(data) AS ks FROM ev)""")
def event_details(spark, sf_dir):
    return query.detail(events(spark, sf_dir))


@_register("""SELECT id, event_type, name, "timestamp", has_more FROM (SELECT *, count(*) OVER () > 50 AS has_more FROM (SELECT * FROM ev ORDER BY "timestamp" DESC, id LIMIT 51)) ORDER BY "timestamp" DESC, id LIMIT 50""")
def page_1(spark, sf_dir):
    return query.page(events(spark, sf_dir), 1).select("id", "event_type", "name", "timestamp", "has_more")


@_register("""SELECT id, event_type, name, "timestamp", has_more FROM (SELECT *, count(*) OVER () > 50 AS has_more FROM (SELECT * FROM ev ORDER BY "timestamp" DESC, id LIMIT 51 OFFSET 4950)) ORDER BY "timestamp" DESC, id LIMIT 50""")
def page_100(spark, sf_dir):
    return query.page(events(spark, sf_dir), 100).select("id", "event_type", "name", "timestamp", "has_more")


@_register("SELECT count(*) AS total FROM ev WHERE event_type = 'single' AND name ILIKE '%OT%'")
def matched_total(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.where(filters.kind_filter("single") & filters.name_contains(" OT ")).agg(F.count("*").alias("total"))


_SEARCHES = {
    "slow": (Filter().with_duration("gte", 3_600_000), "duration_ms >= 3600000"),
    "duration_in": (Filter().with_duration("in", [0, 1000, 60_000]), "duration_ms IN (0, 1000, 60000)"),
    "january_tenth": (Filter().with_timestamp("gte", "2024-01-10 00:00:00").with_timestamp("lt", "2024-01-11 00:00:00"), "\"timestamp\" >= '2024-01-10' AND \"timestamp\" < '2024-01-11'"),
    "time_like": (Filter().with_timestamp("like", "2024-01-1%"), "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') LIKE '2024-01-1%'"),
    "errors": (Filter().with_data("level", "eq", "ERROR"), "level = 'ERROR'"),
    "cents_like": (Filter().with_data("cents", "like", "1%"), "cents LIKE '1%'"),
    "name_in": (Filter().with_name("in", ["note", "request"]), "name IN ('note', 'request')"),
    "name_none": (Filter().with_name("in", []), "false"),
    "name_like": (Filter().with_name("like", "REQ%"), "name ILIKE 'REQ%'"),
    "either": (Filter(filters.or_([filters.data("status", "eq", "500"), filters.data("level", "eq", "ERROR")])), "status = '500' OR level = 'ERROR'"),
    "both": (Filter(filters.and_([filters.or_([filters.name("eq", "note"), filters.duration("gt", 1000)]), filters.timestamp("gt", "2024-01-15")])), "(name = 'note' OR duration_ms > 1000) AND \"timestamp\" > '2024-01-15'"),
    "orphans": (Filter().with_parent_id("gte", "8"), "parent_id >= '8'"),
    "id_lte": (Filter().with_id("lte", "8"), "id <= '8'"),
    "all": (Filter(), "true"),
}


@_register(" UNION ALL ".join(f"SELECT '{n}' AS search, count(*) AS n FROM ev WHERE {sql}" for n, (_, sql) in _SEARCHES.items()))
def saved_searches(spark, sf_dir):
    return query.saved_searches(events(spark, sf_dir), {n: f for n, (f, _) in _SEARCHES.items()})


@_register(f"SELECT {_COLUMNS} FROM ev WHERE (name = 'note' OR duration_ms > 1000) AND \"timestamp\" > '2024-01-15'")
def filtered_events(spark, sf_dir):
    return _scalars(_SEARCHES["both"][0].apply(events(spark, sf_dir)))


@_register("SELECT id, name, \"timestamp\" FROM ev WHERE lower(raw_line) LIKE '%status=500%' AND lower(raw_line) LIKE '%op=op1%'")
def full_text(spark, sf_dir):
    return query.full_text(events(spark, sf_dir), ["STATUS=500", "op=op1"]).select("id", "name", "timestamp")


@_register("SELECT id, \"timestamp\" FROM ev WHERE \"timestamp\" >= TIMESTAMP '2024-01-25' - INTERVAL 48 HOUR AND name ILIKE '%app%' AND level = 'ERROR' AND cents LIKE '1%'")
def combined_search(spark, sf_dir):
    found = query.combined(events(spark, sf_dir), NOW, timedelta(hours=48), name="app", level="error", filter_=Filter().with_data("cents", "like", "1%"))
    return found.select("id", "timestamp")


_HOUR = "date_trunc('hour', \"timestamp\")"


@_register(f"""SELECT b.bucket, b.name, coalesce(n, 0) AS n FROM (
  SELECT name, unnest(generate_series(min({_HOUR}), max({_HOUR}), INTERVAL 1 HOUR)) AS bucket FROM ev GROUP BY name) b
LEFT JOIN (SELECT {_HOUR} AS bucket, name, count(*) AS n FROM ev GROUP BY ALL) c USING (bucket, name)""")
def counts_by_name(spark, sf_dir):
    return metrics.counts(events(spark, sf_dir))


@_register(f"SELECT {_HOUR} AS bucket, level, count(*) AS n FROM ev GROUP BY ALL")
def counts_by_level(spark, sf_dir):
    return metrics.counts(metrics.with_level(events(spark, sf_dir)), "level", fill=False)


@_register(f"SELECT {_HOUR} AS bucket, count(*) AS n, count(*) FILTER (level = 'ERROR') AS errors, round(count(*) FILTER (level = 'ERROR') / count(*), 3) AS rate FROM ev GROUP BY ALL")
def error_rate(spark, sf_dir):
    return metrics.error_rate(events(spark, sf_dir))


@_register(f"SELECT {_HOUR} AS bucket, name, count(*) AS n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round(avg(duration_ms), 3) AS avg_ms FROM ev GROUP BY ALL")
def duration_stats(spark, sf_dir):
    return metrics.durations(events(spark, sf_dir))


@_register(f"""SELECT {_HOUR} AS bucket, name, round(quantile_cont(duration_ms, 0.5), 3) AS p50, round(quantile_cont(duration_ms, 0.95), 3) AS p95, round(quantile_cont(duration_ms, 0.99), 3) AS p99
FROM ev WHERE event_type = 'span' GROUP BY ALL""")
def duration_percentiles(spark, sf_dir):
    return metrics.percentiles(events(spark, sf_dir))


@_register("""SELECT id AS root_id, id, 0 AS depth, name AS path FROM ev WHERE parent_id IS NULL
UNION ALL SELECT p.id, c.id, 1, p.name || ';' || c.name FROM ev c JOIN ev p ON c.parent_id = p.id""")
def tree_paths(spark, sf_dir):
    return tree.tree_paths(events(spark, sf_dir)).select("root_id", "id", "depth", F.array_join("path", ";").alias("path"))


@_register("""SELECT id AS root_id, id, name, 0 AS depth, CAST(0 AS BIGINT) AS start_offset_ms, duration_ms FROM ev WHERE parent_id IS NULL
UNION ALL SELECT p.id, c.id, c.name, 1, CAST((epoch_us(c."timestamp") - epoch_us(p."timestamp")) // 1000 AS BIGINT), c.duration_ms FROM ev c JOIN ev p ON c.parent_id = p.id""")
def waterfall(spark, sf_dir):
    return tree.waterfall(events(spark, sf_dir))


@_register("SELECT name AS stack, CAST(sum(greatest(0, duration_ms)) AS BIGINT) AS self_ms FROM ev WHERE event_type = 'span' GROUP BY name")
def folded_stacks(spark, sf_dir):
    return tree.folded(events(spark, sf_dir))


_RULES = {"errors": Filter().with_data("level", "eq", "ERROR"), "slow": Filter().with_duration("gt", 5000)}
_MATCH = """, rule AS (SELECT 'errors' AS rule, id, "timestamp" FROM ev WHERE level = 'ERROR' UNION ALL SELECT 'slow', id, "timestamp" FROM ev WHERE duration_ms > 5000)
, burst AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY rule ORDER BY "timestamp" RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS recent FROM rule) WHERE recent > 4)
"""


@_register(_MATCH + 'SELECT rule, id, "timestamp" FROM rule')
def alert_matches(spark, sf_dir):
    return alerts.matching(events(spark, sf_dir), _RULES).select("rule", "id", "timestamp")


@_register(_MATCH + "SELECT rule, strftime(\"timestamp\", '%Y-%m') AS event_month, count(*) AS n FROM rule GROUP BY ALL")
def stored_alerts(spark, sf_dir):
    """Matches are stored by rule and month; a second append of the same ones adds nothing."""
    path = scratch(spark, "alerts")
    for _ in range(2):
        store.append_alerts(alert_matches(spark, sf_dir), path)
    kept = spark.read.parquet(path)
    return kept.groupBy(F.col("rule").cast("string").alias("rule"), F.col("event_month").cast("string").alias("event_month")).agg(F.count("*").alias("n"))


@_register("""SELECT id, event_type, name, "timestamp", duration_ms, parent_id, data, replace(raw_line, chr(10), '|') AS raw_line FROM ev""")
def exported_files(spark, sf_dir):
    """Events written as JSON lines, read back, written as CSV, and read back."""
    root = scratch(spark, "export")
    store.export_json(events(spark, sf_dir), f"{root}/json")
    back = spark.read.schema(EVENT).json(f"{root}/json")
    store.export_csv(back, f"{root}/csv")
    found = spark.read.options(header=True, escape='"', multiLine=True).schema("id string, event_type string, name string, timestamp string, duration_ms long, parent_id string, data string, raw_line string").csv(f"{root}/csv")
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("raw_line", F.replace("raw_line", F.lit("\n"), F.lit("|")))


def _bursts(spark, sf_dir):
    return alerts.bursts(alert_matches(spark, sf_dir), more_than=4, minutes=60)


@_register(_MATCH + 'SELECT rule, id, "timestamp", recent FROM burst')
def alert_bursts(spark, sf_dir):
    return _bursts(spark, sf_dir)


@_register(_MATCH + """SELECT rule, min("timestamp") AS fired_at, max("timestamp") AS last_at, count(*) AS matched, max("timestamp") + INTERVAL 60 MINUTE AS resolved_at FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR "timestamp" > prev + INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY rule ORDER BY "timestamp", id) AS island FROM (
    SELECT *, lag("timestamp") OVER (PARTITION BY rule ORDER BY "timestamp", id) AS prev FROM burst)) GROUP BY rule, island""")
def alert_history(spark, sf_dir):
    return alerts.history(_bursts(spark, sf_dir), minutes=60)


@_register(_MATCH + """SELECT rule, id, "timestamp" FROM rule WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT 'errors' AS r, \"timestamp\" AS a FROM ev WHERE duration_ms > 86400000) q WHERE r = rule AND "timestamp" >= a AND "timestamp" < a + INTERVAL 30 MINUTE)""")
def unsilenced_alerts(spark, sf_dir):
    """Errors are silenced for half an hour from the start of each span of over a day."""
    rows = written(events(spark, sf_dir), "events")
    quiet = rows.where("duration_ms > 86400000").select(F.lit("errors").alias("rule"), F.col("timestamp").alias("start"), F.expr("timestamp + interval 30 minutes").alias("stop"))
    return alerts.unsilenced(alerts.matching(rows, _RULES).select("rule", "id", "timestamp"), quiet)


@_register("""SELECT after_id, ref, before_id, wait_ms FROM (
  SELECT a.id AS after_id, a.ref, b.id AS before_id, CAST((epoch_us(b."timestamp") - epoch_us(a."timestamp")) // 1000 - a.duration_ms AS BIGINT) AS wait_ms,
    row_number() OVER (PARTITION BY a.id ORDER BY (epoch_us(b."timestamp") - epoch_us(a."timestamp")) // 1000 - a.duration_ms, b.id) AS n
  FROM ev a JOIN ev b ON a.ref = b.ref AND a.event_type = 'span' AND b.event_type = 'span' AND a.id <> b.id
  WHERE (epoch_us(b."timestamp") - epoch_us(a."timestamp")) // 1000 - a.duration_ms BETWEEN 0 AND 86400000) WHERE n = 1""")
def queue_wait(spark, sf_dir):
    return alerts.queue_wait(written(events(spark, sf_dir).where("event_type = 'span'"), "events"), "request", "request", "ref", 86_400_000)


@_register(f"SELECT {_COLUMNS} FROM ev WHERE NOT (name = 'app_log' AND \"timestamp\" < TIMESTAMP '2024-01-25' - INTERVAL 7 DAY) AND NOT (name = 'note' AND \"timestamp\" < TIMESTAMP '2024-01-25' - INTERVAL 2 DAY)")
def retained_events(spark, sf_dir):
    return _scalars(store.retained(events(spark, sf_dir), {"app_log": 7, "note": 2}, NOW))


@_register("SELECT strftime(\"timestamp\", '%Y-%m') AS event_month, count(*) AS n FROM ev GROUP BY 1")
def stored_months(spark, sf_dir):
    """Written by month, written again without effect, and read back."""
    path = scratch(spark, "events")
    rows = events(spark, sf_dir)
    store.append_events(rows, path)
    store.append_events(rows, path)
    return spark.read.parquet(path).groupBy(F.col("event_month").cast("string").alias("event_month")).agg(F.count("*").alias("n"))


@_register("""SELECT id, event_type, name, "timestamp", CASE WHEN event_type = 'span' THEN duration_ms END AS duration_ms, parent_id, data, raw_line,
  CASE WHEN event_type = 'span' THEN split_part(raw_line, chr(10), 1) END AS raw_start, CASE WHEN event_type = 'span' THEN split_part(raw_line, chr(10), 2) END AS raw_end FROM ev""")
def row_encoding(spark, sf_dir):
    rows = store.decode_rows(store.encode_rows(events(spark, sf_dir)))
    return rows.withColumn("data", sorted_json(F.col("data")))


@_register("SELECT id, event_type, name, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S') AS \"timestamp\", duration_ms, parent_id, data, raw_line FROM ev")
def export_rows(spark, sf_dir):
    return store.export_rows(events(spark, sf_dir))


@_register("SELECT 'app-' || CAST(user_id % 4 AS VARCHAR) || '.log' AS file_path, arg_max(event_id, event_id) AS cursor FROM events GROUP BY 1", common=False)
def file_cursors(spark, sf_dir):
    saves = event_lines(spark, sf_dir).select("file_path", F.col("byte_offset").alias("cursor"), F.col("byte_offset").alias("seq"))
    return store.latest_cursors(saves)


@_register("""SELECT f.file_path, CASE WHEN p.file_path IS NOT NULL THEN least(f.size, f.size // 2) ELSE f.size END AS "offset" FROM (SELECT file_path, max(byte_offset) AS size FROM line GROUP BY 1) f
LEFT JOIN (SELECT DISTINCT file_path FROM (SELECT file_path, ref, arg_max(kind, byte_offset) AS kind FROM o WHERE kind <> 'N' GROUP BY ALL) WHERE kind = 'S') p USING (file_path)""")
def resume_offsets(spark, sf_dir):
    files = event_lines(spark, sf_dir).groupBy("file_path").agg(F.max("byte_offset").alias("size"))
    return store.resume(files, files.select("file_path", F.floor(F.col("size") / 2).alias("cursor")), parsed(spark, sf_dir).pending)


@_register("""SELECT event_id, date_trunc('second', ts) AS "timestamp", date_trunc('day', ts) AS day FROM events""", common=False)
def date_texts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", short_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), short_date(F.date_format("ts", "yyyy-MM-dd")).alias("day"))


def _as_text(spark, sf_dir, logfmt: bool) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    text = F.format_string('timestamp="%s" level=x level=%s user=%d msg="say \\"hi\\" to %d"', "timestamp", "event_type", "user_id", "user_id") if logfmt else F.to_json(F.struct("timestamp", F.col("event_type").alias("level"), F.col("user_id").alias("user")))
    return e.select(F.lit("in").alias("file_path"), F.col("event_id").alias("byte_offset"), text.alias("line"))


@_register("SELECT event_id, date_trunc('second', ts) AS \"timestamp\", event_type AS level, CAST(user_id AS VARCHAR) AS user FROM events", common=False)
def json_ingest(spark, sf_dir):
    lines = _as_text(spark, sf_dir, False)
    found = formats.json_events(lines)
    keyed = lines.select("byte_offset", formats.event_id("json", F.col("file_path"), F.col("byte_offset")).alias("id"))
    return found.join(keyed, "id").select(F.col("byte_offset").alias("event_id"), "timestamp", F.col("data")["level"].alias("level"), F.col("data")["user"].alias("user"))


@_register("SELECT event_id, date_trunc('second', ts) AS \"timestamp\", event_type AS level, 'say \"hi\" to ' || CAST(user_id AS VARCHAR) AS msg FROM events", common=False)
def logfmt_ingest(spark, sf_dir):
    lines = _as_text(spark, sf_dir, True)
    keyed = lines.select("byte_offset", formats.event_id("logfmt", F.col("file_path"), F.col("byte_offset")).alias("id"))
    found = formats.logfmt_events(lines).join(keyed, "id")
    return found.select(F.col("byte_offset").alias("event_id"), "timestamp", F.col("data")["level"].alias("level"), F.col("data")["msg"].alias("msg"))


def _pieces(spark, sf_dir, root: str) -> DataFrame:
    """The lines as a stream of four batches in line order."""
    lines = event_lines(spark, sf_dir)
    most = lines.agg(F.max("byte_offset")).first()[0] or 0
    for k in range(4):  # FILES files a batch, in order of time
        part = lines.where((F.col("byte_offset") * 4 >= k * (most + 1)) & (F.col("byte_offset") * 4 < (k + 1) * (most + 1)))
        part.repartition(FILES).write.mode("append").parquet(f"{root}/lines")
    return spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", FILES).parquet(f"{root}/lines")


@_register(f"SELECT {_COLUMNS} FROM ev")
def stream_events(spark, sf_dir):
    """The lines as a stream of four batches; open spans cross the batches."""
    root = scratch(spark, "stream")
    start_ingest(_pieces(spark, sf_dir, root), load_config(CONFIG), root).awaitTermination()
    return _scalars(spark.read.parquet(f"{root}/events").drop("batch"))


@_register(f"SELECT {_COLUMNS} FROM ev")
def keyed_stream_events(spark, sf_dir):
    """The same stream by the keyed state operator."""
    root = scratch(spark, "keyed")
    start_keyed(_pieces(spark, sf_dir, root), load_config(CONFIG), root).awaitTermination()
    return _scalars(spark.read.schema(EVENT).parquet(f"{root}/events"))


@_register(f"SELECT {_COLUMNS} FROM ev WHERE byte_offset * 2 >= (SELECT max(byte_offset) + 1 FROM line)")
def restored_stream(spark, sf_dir):
    """A stream of the second half of the lines that begins with the first half's open spans, and with some of no known file or parser."""
    root, parsers, lines = scratch(spark, "restored"), load_config(CONFIG), event_lines(spark, sf_dir)
    most = lines.agg(F.max("byte_offset")).first()[0] or 0
    late = F.col("byte_offset") * 2 >= most + 1
    saved = written(parse_logs(lines.where(~late), parsers).pending, "pending")
    odd = saved.withColumn("parser_name", F.lit("gone")).unionByName(saved.withColumn("file_path", F.concat("file_path", F.lit(".old"))))
    lines.where(late).write.parquet(f"{root}/lines")
    stream = spark.readStream.schema(lines.schema).parquet(f"{root}/lines")
    start_ingest(stream, parsers, root, restored=saved.unionByName(odd), disjoint=True).awaitTermination()
    return _scalars(spark.read.parquet(f"{root}/events").drop("batch"))


def _timed_stream(spark, rows: DataFrame, root: str) -> DataFrame:
    """Rows with a timestamp as a stream of four batches in order of time, and a fifth with one row that comes too late."""
    rows = written(rows, "rows")
    low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    for k in range(4):
        at = lambda j: F.lit(low + (high - low) * j / 4).cast("timestamp_ntz")
        part = (F.col("timestamp") >= at(k)) & ((F.col("timestamp") < at(k + 1)) | F.lit(k == 3))
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    rows.orderBy("timestamp").limit(1).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def _ran(found: DataFrame, root: str) -> DataFrame:
    found.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{root}/out")


@_register(f"""SELECT * FROM (SELECT {_HOUR} AS bucket, name, count(*) AS n FROM ev GROUP BY ALL) WHERE bucket + INTERVAL 1 HOUR <= (SELECT max("timestamp") FROM ev) - INTERVAL 10 MINUTE""")
def stream_hourly_counts(spark, sf_dir):
    """Counts by hour of event time, of the hours that the watermark has passed; the late row is dropped."""
    root = scratch(spark, "counts")
    found = windowed_counts(_timed_stream(spark, events(spark, sf_dir).select("timestamp", "name"), root), lateness="10 minutes")
    return _ran(found.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "name", "n"), root)


@_register(_MATCH + """SELECT rule, start, count(*) AS n FROM (SELECT rule, unnest(generate_series(date_trunc('minute', "timestamp") - INTERVAL 59 MINUTE, date_trunc('minute', "timestamp"), INTERVAL 1 MINUTE)) AS start FROM rule)
WHERE start + INTERVAL 60 MINUTE <= (SELECT max("timestamp") FROM rule) - INTERVAL 10 MINUTE GROUP BY ALL HAVING count(*) > 4""")
def stream_bursts(spark, sf_dir):
    """Sliding hours of a stream of matches with more than four of a rule."""
    root = scratch(spark, "bursts")
    found = burst_windows(_timed_stream(spark, alert_matches(spark, sf_dir).select("rule", "timestamp"), root), more_than=4, minutes=60)
    return _ran(found.select("rule", F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), root)


_NESTED = CONFIG[: CONFIG.index("[[parsers.nested]]")] + r"""
[[parsers.nested]]
name = "task"
type = "span"
reference_fields = ["job"]
start_pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) TASK (?P<job>\d) ON'
end_pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) TASK (?P<job>\d) OFF'
[[parsers.nested.nested]]
name = "step"
type = "single"
pattern = '(?P<timestamp>${timestamp}) (?P<ref>${ref}) STEP (?P<job>\d)'
"""


def nested_lines(spark, sf_dir) -> DataFrame:
    """The notes become tasks that begin and end within a request, the other lines steps of a task."""
    at, text = F.col("byte_offset"), F.col("line")
    head = F.concat(F.substring("line", 1, 19), F.lit(" U"), F.lpad((at % 20).cast("string"), 6, "0"))
    job = (F.floor(at / 2) % 2).cast("string")
    task = F.concat(head, F.lit(" TASK "), job, F.when(at % 3 == 0, " OFF").otherwise(" ON"))
    line = F.when(text.contains(" NOTE "), task).when(text.contains(" LOG "), F.concat(head, F.lit(" STEP "), job)).otherwise(F.regexp_replace(text, r" U\d{6}", F.concat(F.lit(" U"), F.lpad((at % 20).cast("string"), 6, "0"))))
    return event_lines(spark, sf_dir).select(F.lit("app-0.log").alias("file_path"), "byte_offset", line.alias("line"))


_NESTED_SQL = f"""WITH l AS (
  SELECT 'app-0.log' AS file_path, event_id AS byte_offset, event_id % 20 AS ref, (event_id // 2) % 2 AS job,
    CASE event_type WHEN 'click' THEN 'S' WHEN 'purchase' THEN 'E' WHEN 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'OFF' ELSE 'ON' END ELSE 'STEP' END AS kind FROM events
), a AS (
  SELECT *, last_value(CASE WHEN kind IN ('S', 'E') THEN kind END IGNORE NULLS) OVER o AS b1, last_value(CASE WHEN kind IN ('ON', 'OFF') THEN kind END IGNORE NULLS) OVER i AS b2 FROM l
  WINDOW o AS (PARTITION BY ref ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i AS (PARTITION BY ref, job ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), b AS (
  SELECT *, last_value(CASE WHEN kind = 'S' AND coalesce(b1, 'E') = 'E' THEN byte_offset END IGNORE NULLS) OVER o AS s1, last_value(CASE WHEN kind = 'ON' AND coalesce(b2, 'OFF') = 'OFF' THEN byte_offset END IGNORE NULLS) OVER i AS s2 FROM a
  WINDOW o AS (PARTITION BY ref ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i AS (PARTITION BY ref, job ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), n AS (
  SELECT {_uuid("request", "s1")} AS id, 'request' AS name, CAST(NULL AS VARCHAR) AS outermost, CAST(NULL AS VARCHAR) AS nearest FROM b WHERE kind = 'E' AND b1 = 'S'
  UNION ALL SELECT {_uuid("task", "s2")}, 'task', {_uuid("request", "s1")}, {_uuid("request", "s1")} FROM b WHERE kind = 'OFF' AND b2 = 'ON' AND b1 = 'S'
  UNION ALL SELECT {_uuid("step")}, 'step', {_uuid("request", "s1")}, {_uuid("task", "s2")} FROM b WHERE kind = 'STEP' AND b2 = 'ON' AND b1 = 'S'
)"""


def _nested(spark, sf_dir, **how) -> DataFrame:
    return parse_logs(nested_lines(spark, sf_dir), load_config(_NESTED), **how).events.select("id", "name", "parent_id")


@_register(_NESTED_SQL + "SELECT id, name, outermost AS parent_id FROM n", common=False)
def nested_spans(spark, sf_dir):
    """Requests, tasks within them, and steps within tasks, which belong to the request."""
    return _nested(spark, sf_dir)


@_register(_NESTED_SQL + "SELECT id, name, nearest AS parent_id FROM n", common=False)
def nearest_parents(spark, sf_dir):
    """The same in one pass over the lines, steps belonging to their task."""
    return _nested(spark, sf_dir, parent_mode="nearest", disjoint=True)


@_register("SELECT id, \"timestamp\", duration_ms FROM ev WHERE event_type = 'span' AND duration_ms > 1000")
def sql_store_events(spark, sf_dir):
    """Events in a table of a SQL database, appended twice, read over several connections. The database lies in the shared folder and is opened by the driver's JVM, so this one is for local mode."""
    target = scratch(spark, "database").removeprefix("file://").removeprefix("file:")
    kept = store.open_store({"type": "jdbc", "url": f"jdbc:derby:{target};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    rows = written(events(spark, sf_dir).where("event_type = 'span'"), "events")
    for _ in range(2):
        kept.append(rows)
    return kept.load(spark, Filter().with_duration("gt", 1000)).select("id", "timestamp", "duration_ms")


@_register("""SELECT event_id, date_trunc('second', ts) AS "timestamp" FROM events WHERE event_id % 5 <> 4""", common=False)
def rare_formats(spark, sf_dir):
    """Times of five formats that Spark's patterns can't say; every fifth names a wrong weekday."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    wrong = F.date_format(F.expr("ts + interval 1 day"), "EEE")
    texts = {
        "%y%m%d %H%M%S": F.date_format("ts", "yyMMdd HHmmss"), "%s": F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), "%d/%b/%Y:%H:%M:%S %z": F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200")),
        "%Y-%j %T": F.date_format("ts", "yyyy-DDD HH:mm:ss"), "%a, %d %b %Y %T": F.concat(wrong, F.date_format("ts", ", dd MMM yyyy HH:mm:ss")),
    }
    at = F.coalesce(*[F.when(F.col("event_id") % 5 == k, timestamp(text, spark_time_format(fmt))) for k, (fmt, text) in enumerate(texts.items())])
    return e.select("event_id", at.alias("timestamp")).where("timestamp is not null")


@_register("SELECT file_path, CASE WHEN file_path IN ('app-0.log', 'app-1.log') THEN 'early' ELSE 'late' END AS name, count(*) AS n FROM line WHERE kind = 'L' GROUP BY ALL")
def glob_events(spark, sf_dir):
    """Two parsers that read the same lines, each for the files of its own glob; the first in order wins."""
    one = {"type": "single", "pattern": r"(?P<timestamp>${timestamp}) LOG level=(?P<level>\w+) cents=(?P<cents>\d+)", "timestamp_format": "%Y-%m-%d %H:%M:%S"}
    parsers = [{**one, "name": "early", "glob": "app-[01].log"}, {**one, "name": "late", "glob": "app-*.log"}]
    config = load_config({"components": {"timestamp": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"}, "parsers": parsers})
    return parse_logs(event_lines(spark, sf_dir), config).events.groupBy("file_path", "name").agg(F.count("*").alias("n"))


@_register("""SELECT file_path, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY file_path ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset, line FROM line""")
def text_offsets(spark, sf_dir):
    """The lines as text files, read back with the byte offset of each."""
    root = scratch(spark, "text")
    lines = event_lines(spark, sf_dir).repartition("file_path").sortWithinPartitions("file_path", "byte_offset")
    lines.select("file_path", "line").write.partitionBy("file_path").text(root)
    found = read_lines(spark, f"{root}/*/*.txt", piece_bytes=100_000)
    return found.select(F.regexp_extract("file_path", "file_path=([^/]+)/", 1).alias("file_path"), "byte_offset", "line")


@_register("SELECT file_path, count(*) AS n, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM line GROUP BY file_path")
def tailed_lines(spark, sf_dir):
    """The lines as text files, tailed by address in batches of bounded size."""
    root = scratch(spark, "tailed")
    event_lines(spark, sf_dir).repartition("file_path").sortWithinPartitions("file_path", "byte_offset").select("file_path", "line").write.partitionBy("file_path").text(f"{root}/in")
    spark.dataSource.register(TailSource)
    size = spark.read.format("binaryFile").load(f"{root}/in/*/*.txt").agg(F.sum("length")).first()[0] or 0
    stream = spark.readStream.format("logtail").options(path=f"{root}/in/*/*.txt", starting_position="earliest", max_bytes=str(size // 3 + 1)).load()
    query_ = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime="0 seconds").start(f"{root}/out")
    batches = -1
    try:
        while batches < (batches := len(query_.recentProgress)):  # a call waits for what was there at the next poll
            query_.processAllAvailable()
    finally:
        query_.stop()
    found = spark.read.schema(LINES).parquet(f"{root}/out").withColumn("file_path", F.regexp_extract("file_path", "file_path=([^/]+)/", 1))
    return found.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"))


@_register("SELECT id, \"timestamp\" FROM ev WHERE name = 'note' AND \"timestamp\" >= TIMESTAMP '2024-01-10'")
def loaded_events(spark, sf_dir):
    path = scratch(spark, "events")
    store.append_events(events(spark, sf_dir), path)
    return store.load_events(spark, path, Filter().with_name("eq", "note").with_timestamp("gte", "2024-01-10 00:00:00")).select("id", "timestamp")


@_register(f"""SELECT file_path, {_uuid("request", "s_at")} AS id FROM (
  SELECT file_path, ref, arg_max(kind, byte_offset) AS kind, max(CASE WHEN opens THEN byte_offset END) AS s_at FROM o
  WHERE kind <> 'N' AND (file_path IN ('app-0.log', 'app-1.log') OR byte_offset * 2 < (SELECT max(byte_offset) + 1 FROM line)) GROUP BY file_path, ref) WHERE kind = 'S'""")
def pending_replaced(spark, sf_dir):
    """Open spans of the first half of the lines, of which two files' are replaced by those of all lines."""
    lines, parsers = event_lines(spark, sf_dir), load_config(CONFIG)
    most = lines.agg(F.max("byte_offset")).first()[0] or 0
    half = parse_logs(lines.where(F.col("byte_offset") * 2 < most + 1), parsers).pending
    two = parse_logs(lines.where(F.col("file_path").isin("app-0.log", "app-1.log")), parsers).pending
    touched = spark.createDataFrame([("app-0.log", "request"), ("app-1.log", "request")], "file_path string, parser_name string")
    return store.replace_pending(half, two, touched).select("file_path", "id")


@_register("SELECT name, count(*) AS n, count(CASE WHEN name <> 'app_log' THEN raw_line END) AS with_raw FROM ev GROUP BY name")
def raw_left_out(spark, sf_dir):
    parsers = load_config(CONFIG.replace('name = "app_log"', 'name = "app_log"\ninclude_raw = false'))
    return parse_logs(event_lines(spark, sf_dir), parsers).events.groupBy("name").agg(F.count("*").alias("n"), F.count("raw_line").alias("with_raw"))


@_register(f"""WITH {_LINES}, b AS (SELECT *, byte_offset % 11 <> 0 AS good FROM line), m AS (
  SELECT *, last_value(CASE WHEN kind <> 'N' THEN kind END IGNORE NULLS) OVER (PARTITION BY file_path, ref ORDER BY byte_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM b WHERE kind <> 'L' AND (good OR kind = 'E'))
SELECT CASE kind WHEN 'E' THEN 'request' ELSE 'note' END AS name, count(*) AS n FROM m WHERE good AND before = 'S' AND kind <> 'S' GROUP BY 1
UNION ALL SELECT 'app_log', count(*) FROM b WHERE kind = 'L' AND good""", common=False)
def bad_timestamps(spark, sf_dir):
    """Every eleventh line names a month 13: such a START opens nothing, such an END closes and loses its span."""
    return parse_logs(_month_13(event_lines(spark, sf_dir)), load_config(CONFIG)).events.groupBy("name").agg(F.count("*").alias("n"))


@_register("""SELECT CAST(event_id - event_id % 20 AS VARCHAR) AS root_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id % 20 AS INTEGER) AS depth
FROM events WHERE event_id - event_id % 20 IN (SELECT event_id FROM events)""", common=False)
def deep_tree(spark, sf_dir):
    """Chains of twenty events, each the parent of the next."""
    at = F.col("event_id")
    parent = F.when(at % 20 != 0, (at - 1).cast("string"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        at.cast("string").alias("id"), parent.alias("parent_id"), F.col("event_type").alias("name"), F.col("ts").alias("timestamp"), F.lit(1).cast("long").alias("duration_ms"), F.lit("span").alias("event_type")
    )
    return tree.tree_paths(e).select("root_id", "id", "depth")


@_register("""SELECT CAST(event_id - event_id % 20 AS VARCHAR) AS root_id, CAST(event_id AS VARCHAR) AS id, CAST(event_id % 20 AS INTEGER) AS depth
FROM events WHERE event_id - event_id % 20 IN (SELECT event_id FROM events) AND (event_id % 60 < 40 OR event_id % 20 < 7)""", common=False)
def cyclic_tree(spark, sf_dir):
    """Chains of twenty events, of which each third has a cycle below its seventh event; every id comes again with another parent and a later time."""
    at, e = F.col("event_id"), spark.read.parquet(f"{sf_dir}/events.parquet")
    parent = F.when((at % 60 >= 40) & (at % 20 == 7), at + 2).when(at % 20 != 0, at - 1)
    rows = e.select(at.cast("string").alias("id"), parent.cast("string").alias("parent_id"), F.col("event_type").alias("name"), F.col("ts").alias("timestamp"), F.lit(1).cast("long").alias("duration_ms"), F.lit("span").alias("event_type"))
    again = rows.withColumns({"parent_id": F.lit("0"), "timestamp": F.expr("timestamp + interval 1 day")})
    return tree.tree_paths(rows.unionByName(again)).select("root_id", "id", "depth")


@_register("SELECT CAST(event_id AS VARCHAR) AS id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS INTEGER) AS depth FROM events", common=False)
def chain_depths(spark, sf_dir):
    """One chain of all events: each hangs under the one before."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("name"))
    rows = e.join(e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_id").cast("string").alias("parent_id")), "event_id", "left")
    rows = rows.select(F.col("event_id").cast("string").alias("id"), "parent_id", "name", "timestamp", F.lit(1).cast("long").alias("duration_ms"), F.lit("span").alias("event_type"))
    return tree.tree_paths(rows, paths=False).select("id", "depth")


@_register(_MATCH + """SELECT rule, id, "timestamp" FROM rule WHERE NOT (rule = 'slow' AND "timestamp" >= (SELECT max("timestamp") FROM ev) - INTERVAL 5 DAY)
AND NOT (rule = 'slow' AND "timestamp" < (SELECT min("timestamp") FROM ev) + INTERVAL 2 DAY) AND NOT (rule = 'errors' AND "timestamp" >= TIMESTAMP '2024-01-20')
AND NOT (rule = 'errors' AND date_trunc('day', "timestamp") IN (SELECT date_trunc('day', "timestamp") FROM ev WHERE duration_ms > 432000000))""")
def long_silences(spark, sf_dir):
    """One rule is quiet to the year 9999 and from the year 1, the other without an end and on the days when a span of over five days began."""
    rows = written(events(spark, sf_dir), "events")
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    silence = lambda df, rule, start, stop: df.select(F.lit(rule).alias("rule"), start.alias("start"), stop.alias("stop"))
    ends = rows.agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    quiet = silence(ends, "slow", F.expr("high - interval 5 days"), at("9999-12-31 00:00:00")).unionByName(silence(ends, "slow", at("0001-01-01 00:00:00"), F.expr("low + interval 2 days")))
    quiet = quiet.unionByName(silence(ends, "errors", at("2024-01-20 00:00:00"), F.lit(None).cast("timestamp_ntz")))
    quiet = quiet.unionByName(silence(rows.where("duration_ms > 432000000"), "errors", day, day + F.expr("interval 1 day")).distinct())
    return alerts.unsilenced(alerts.matching(rows, _RULES).select("rule", "id", "timestamp"), quiet)


@_register("""SELECT id, event_type, name, "timestamp", has_more FROM (SELECT *, count(*) OVER () > 50 AS has_more FROM (SELECT * FROM ev ORDER BY "timestamp" DESC, id LIMIT 51 OFFSET 5900)) ORDER BY "timestamp" DESC, id LIMIT 50""")
def page_far(spark, sf_dir):
    """Page 119 of stored events: only its range of time is sorted."""
    path = scratch(spark, "events")
    store.append_events(events(spark, sf_dir), path)
    return query.page_by_range(store.load_events(spark, path), 119).select("id", "event_type", "name", "timestamp", "has_more")


@_register("""SELECT date_trunc('day', "timestamp") AS bucket, name, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99
FROM ev WHERE event_type = 'span' GROUP BY ALL""")
def rolled_percentiles(spark, sf_dir):
    """Percentiles of a day from stored digests of its hours, which are the counts of their durations, so that ranks are exact."""
    stored = written(metrics.duration_counts(events(spark, sf_dir)), "counts")
    return metrics.count_percentiles(metrics.rolled_counts(stored))


@_register("SELECT id, \"timestamp\" FROM ev WHERE level = 'ERROR' AND cents LIKE '1%'")
def live_tail_errors(spark, sf_dir):
    """The stored events as a stream, filtered and appended as they come."""
    root = scratch(spark, "tail")
    events(spark, sf_dir).write.parquet(f"{root}/events")
    stream = spark.readStream.schema(spark.read.parquet(f"{root}/events").schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/events")
    found = live_tail(stream, Filter().with_data("level", "eq", "ERROR").with_data("cents", "like", "1%")).select("id", "timestamp")
    found.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/found").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/found")


@_register("SELECT id, \"timestamp\" FROM ev WHERE \"timestamp\" < TIMESTAMP '2024-01-15' OR (\"timestamp\" = TIMESTAMP '2024-01-15' AND id > '8') ORDER BY \"timestamp\" DESC, id LIMIT 50")
def page_after_key(spark, sf_dir):
    """A deep page by the key of the row before it."""
    return query.page_after(events(spark, sf_dir), datetime(2024, 1, 15), "8").select("id", "timestamp")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
