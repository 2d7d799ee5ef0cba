"""Lines to events: single parsers, span pairing with nested parsers, and the chain in which the first claim wins.

Span state follows line order within (file, parser, reference values) and is computed with windows: among the marks of
a key (STARTs with a valid timestamp, and all ENDs) a START opens if the mark before it is none or an END, an END closes
if it is a START, and a nested row belongs to the span that is open at its line. The window's key holds the reference
values, so a large file isn't one task; nor is a reference used all day, if files are cut into chunks (see span_state).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.config import Parser, path_pattern
from emberlog.functions.fields import captures, event_id, timestamp
from emberlog.operators.state import span_state

EVENT = "id string, event_type string, name string, timestamp timestamp_ntz, duration_ms long, parent_id string, data map<string,string>, raw_line string"
PENDING = "file_path string, parser_name string, span_ref array<string>, id string, timestamp timestamp_ntz, data map<string,string>, parent_id string, raw_line string"
PLACE = ["file_path", "byte_offset"]
FOUND = [*PLACE, "id", "event_type", "name", "timestamp", "duration_ms", "parent_id", "data", "raw_line"]


@dataclass
class Parsed:
    events: DataFrame
    pending: DataFrame
    diagnostics: DataFrame
    claims: DataFrame  # file_path, byte_offset, parser


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _raw(parser: Parser, line="line"):
    return F.col(line) if parser.include_raw else F.lit(None).cast("string")


def owned(parser: Parser):
    """Whether a line's file is one of the parser's."""
    return F.lit(True) if parser.glob is None else F.col("file_path").rlike(path_pattern(parser.glob))


def single_events(lines: DataFrame, parser: Parser) -> tuple[DataFrame, DataFrame]:
    """Events of a single parser, and its lines with a bad timestamp."""
    rows = lines.where(F.col("line").rlike(parser.pattern.java)).withColumn("data", captures(F.col("line"), parser.pattern))
    rows = rows.withColumn("timestamp", timestamp(F.col("data")["timestamp"], parser.time_format))
    events = rows.where("timestamp is not null").select(
        *PLACE, event_id(parser.name, *map(F.col, PLACE)).alias("id"), F.lit("single").alias("event_type"), F.lit(parser.name).alias("name"), "timestamp",
        F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("parent_id"), "data", _raw(parser).alias("raw_line"),
    )
    bad = rows.where("timestamp is null").select("file_path", F.lit(parser.name).alias("parser"), F.lit("bad timestamp").alias("reason"))
    return events, bad


def _key(parser: Parser, data="data"):
    return F.array(*[F.col(data)[f] for f in parser.fields])


def span_events(lines: DataFrame, parser: Parser, pending_in: DataFrame | None, parent_mode: str = "outermost", chunk: int | None = None) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """Events, lines claimed by opening a span, open spans at the end (a list with nested ones), and diagnostics."""
    line = F.col("line")
    is_start, is_end = line.rlike(parser.start.java), line.rlike(parser.end.java)
    kind = F.when(is_start, "S").when(is_end, "E")
    rows = lines.withColumn("kind", kind)
    ends = rows.where("kind is not null").withColumn("data", F.when(F.col("kind") == "S", captures(line, parser.start)).otherwise(captures(line, parser.end)))
    ends = ends.withColumn("timestamp", timestamp(F.col("data")["timestamp"], parser.time_format))
    name = F.lit(parser.name)
    diagnostics = [ends.where("timestamp is null").select("file_path", name.alias("parser"), F.lit("bad timestamp").alias("reason"))]
    none = F.lit(None)
    marks = ends.where("kind = 'E' or timestamp is not null").select(
        *PLACE, _key(parser).alias("ref"), "kind", event_id(parser.name, *map(F.col, PLACE)).alias("id"), "timestamp", "data", _raw(parser).alias("raw_line"),
        none.cast("string").alias("event_type"), none.cast("string").alias("name"), none.cast("long").alias("duration_ms"), none.cast("string").alias("parent_id"),
    )
    if pending_in is not None:
        restored = pending_in.where(F.col("parser_name") == parser.name).select(
            "file_path", F.lit(-1).cast("long").alias("byte_offset"), F.col("span_ref").alias("ref"), F.lit("S").alias("kind"), "id", "timestamp", "data", "raw_line",
            none.cast("string").alias("event_type"), none.cast("string").alias("name"), none.cast("long").alias("duration_ms"), "parent_id",
        )
        marks = marks.unionByName(restored)
    # Nested parsers see the lines that are neither START nor END; the first that yields an event decides.
    if parser.nested and all(n.kind == "single" for n in parser.nested):
        return _with_singles(rows, parser, ends, marks, pending_in, diagnostics, parent_mode, chunk)
    rest, inner, open_inner = rows.where("kind is null").drop("kind"), [], []
    for nested in parser.nested:
        if nested.kind == "single":
            found, bad = single_events(rest, nested)
            diagnostics.append(bad)
        else:
            found, _, still_open, more = span_events(rest, nested, pending_in, parent_mode, chunk)
            open_inner += still_open
            diagnostics += more
        inner.append(found)
        rest = rest.join(found.select(*PLACE), PLACE, "left_anti")
    if inner:
        probes = _union(inner).select(*PLACE, _key(parser).alias("ref"), F.lit("N").alias("kind"), "id", "timestamp", "data", "raw_line", "event_type", "name", "duration_ms", "parent_id")
        marks = marks.unionByName(probes)
    return _paired(marks, parser, open_inner, diagnostics, parent_mode, chunk)


def _with_singles(rows, parser: Parser, ends, marks, pending_in, diagnostics, parent_mode, chunk):
    """The marks with rows of nested single parsers, all taken from one pass over the lines."""
    line, kind, inner, bad = F.col("line"), F.col("kind"), F.lit(None), []
    for nested in parser.nested:
        data = captures(line, nested.pattern)
        at = timestamp(data["timestamp"], nested.time_format)
        event = F.struct(F.lit(nested.name).alias("name"), data.alias("data"), at.alias("timestamp"), event_id(nested.name, *map(F.col, PLACE)).alias("id"), _raw(nested).alias("raw_line"))
        fits = line.rlike(nested.pattern.java)
        bad.append(F.when(kind.isNull() & inner.isNull() & fits & at.isNull(), F.lit(nested.name)))
        inner = F.coalesce(inner, F.when(kind.isNull() & fits & at.isNotNull(), event))
    data = F.when(kind == "S", captures(line, parser.start)).when(kind == "E", captures(line, parser.end))
    rows = rows.withColumn("inner", inner).withColumn("own", data)
    at = F.when(kind.isNotNull(), timestamp(F.col("own")["timestamp"], parser.time_format))
    diagnostics.append(rows.select("file_path", F.explode(F.array_compact(F.array(*bad))).alias("parser"), F.lit("bad timestamp").alias("reason")))
    rows = rows.withColumn("timestamp", F.coalesce(at, F.col("inner")["timestamp"])).where("inner is not null or kind = 'E' or (kind = 'S' and timestamp is not null)")
    rows = rows.withColumn("data", F.coalesce("own", F.col("inner")["data"]))
    found = rows.select(
        *PLACE, _key(parser).alias("ref"), F.coalesce("kind", F.lit("N")).alias("kind"), F.coalesce(F.col("inner")["id"], event_id(parser.name, *map(F.col, PLACE))).alias("id"), "timestamp", "data",
        F.when(kind.isNull(), F.col("inner")["raw_line"]).otherwise(_raw(parser)).alias("raw_line"), F.when(kind.isNull(), F.lit("single")).alias("event_type"), F.col("inner")["name"].alias("name"),
        F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("parent_id"),
    )
    if pending_in is not None:
        found = found.unionByName(marks.where("byte_offset < 0"))
    return _paired(found, parser, [], diagnostics, parent_mode, chunk)


def _paired(marks: DataFrame, parser: Parser, open_inner: list[DataFrame], diagnostics: list[DataFrame], parent_mode: str, chunk: int | None):
    """Events, claimed lines, open spans and diagnostics of marks in line order."""
    marks = span_state(marks, ["file_path", "ref"], chunk)
    opened = F.struct("id", "timestamp", "data", "raw_line")
    start, stop = F.col("start"), F.col("data")
    merged = F.map_concat(F.map_filter(stop, lambda k, _: ~F.map_contains_key(start["data"], k)), start["data"])
    # An END that closes becomes the span's event, a nested row that is attached stays one; both in one pass.
    end, parent = F.col("kind") == "E", start["id"] if parent_mode == "outermost" else F.coalesce("parent_id", start["id"])
    either = lambda span, nested: F.when(end, span).otherwise(nested)
    raw = F.concat_ws("\n", start["raw_line"], F.col("raw_line")) if parser.include_raw else F.lit(None).cast("string")
    found = marks.where("before = 'S' and (kind = 'N' or (kind = 'E' and timestamp is not null))").select(
        *PLACE, either(start["id"], F.col("id")).alias("id"), either(F.lit("span"), F.col("event_type")).alias("event_type"), either(F.lit(parser.name), F.col("name")).alias("name"),
        either(start["timestamp"], F.col("timestamp")).alias("timestamp"), either(F.expr("timestampdiff(MILLISECOND, start.timestamp, timestamp)"), F.col("duration_ms")).alias("duration_ms"),
        either(F.lit(None).cast("string"), parent).alias("parent_id"), either(merged, F.col("data")).alias("data"), either(raw, F.col("raw_line")).alias("raw_line"),
    )
    claimed = marks.where("opens and byte_offset >= 0").select(*PLACE)
    diagnostics.append(marks.where("kind = 'S' and not opens").select("file_path", F.lit(parser.name).alias("parser"), F.lit("duplicate start").alias("reason")))
    last = marks.where("kind <> 'N'").groupBy("file_path", "ref").agg(
        F.max_by("kind", "byte_offset").alias("kind"), F.max_by(opened, F.when(F.col("opens"), F.col("byte_offset"))).alias("start")
    )
    pending = last.where("kind = 'S'").select(
        "file_path", F.lit(parser.name).alias("parser_name"), F.col("ref").alias("span_ref"), "start.id", "start.timestamp", "start.data", F.lit(None).cast("string").alias("parent_id"), "start.raw_line"
    )
    return found, claimed, [pending, *open_inner], diagnostics


def parse_logs(lines: DataFrame, parsers: list[Parser], pending_in: DataFrame | None = None, parent_mode: str = "outermost", chunk: int | None = None, disjoint: bool = False) -> Parsed:
    """Events, open spans, diagnostics and claims of lines (file_path, byte_offset, line).

    Parsers whose glob matches the line's file are tried in order. A line is claimed when a parser emits an event for it or opens a span with it; a line
    that isn't goes on to the next parser: no match, bad timestamp, duplicate START, END of nothing, nested event without
    an open span. Restored open spans come before the first line of their file. chunk: bytes of a file after which a reference's
    lines go to another task (see span_state); without it a reference of a file is one task. disjoint: no line fits patterns of two
    parsers, so the lines are read once for all of them, at once (see onepass).
    """
    if disjoint:
        from emberlog.operators.onepass import parse_disjoint

        return parse_disjoint(lines, parsers, pending_in, parent_mode, chunk)
    rest, events, claims, pending, diagnostics = lines.select(*PLACE, "line"), [], [], [], []
    for k, parser in enumerate(parsers):
        mine = rest.where(owned(parser))
        if parser.kind == "single":
            found, bad = single_events(mine, parser)
            diagnostics.append(bad)
            own = rest.where(~owned(parser) | ~F.col("line").rlike(parser.pattern.java) | timestamp(captures(F.col("line"), parser.pattern)["timestamp"], parser.time_format).isNull())
            claimed = found.select(*PLACE)
        else:
            found, opened, still_open, more = span_events(mine, parser, pending_in, parent_mode, chunk)
            pending += still_open
            diagnostics += more
            claimed = found.select(*PLACE).unionByName(opened)
            own = rest.join(claimed, PLACE, "left_anti") if k + 1 < len(parsers) else rest
        events.append(found.select(*FOUND))
        claims.append(claimed.withColumn("parser", F.lit(parser.name)))
        rest = own
    spark = lines.sparkSession
    pending = [p.select(*[x.split()[0] for x in PENDING.split(", ")]) for p in pending] or [spark.createDataFrame([], PENDING)]
    counts = _union(diagnostics).groupBy("file_path", "parser", "reason").agg(F.count("*").alias("n"))
    return Parsed(_union(events), _union(pending), counts, _union(claims))


def _matches(p: Parser):
    own = [x for x in (p.pattern, p.start, p.end) if x is not None]
    return reduce(lambda a, b: a | b, [F.col("line").rlike(x.java) for x in own] + [_matches(n) for n in p.nested])


def file_coverage(lines: DataFrame, parsers: list[Parser], parsed: Parsed) -> DataFrame:
    """By file: its lines, those that no pattern of a parser of the file matches, and bad timestamps (for each parser)."""
    matched = reduce(lambda a, b: a | b, [owned(p) & _matches(p) for p in parsers], F.lit(False))
    counts = lines.groupBy("file_path").agg(F.count("*").alias("lines"), F.count_if(~matched).alias("unmatched"))
    bad = parsed.diagnostics.where("reason = 'bad timestamp'").groupBy("file_path").agg(F.sum("n").alias("bad_timestamps"))
    return counts.join(bad, "file_path", "left").withColumn("bad_timestamps", F.coalesce("bad_timestamps", F.lit(0).cast("long")))


def pattern_coverage(lines: DataFrame, parsers: list[Parser], parsed: Parsed) -> DataFrame:
    """By file and parser: lines that match one of its patterns, that it claimed, and that others claimed."""
    flags = F.array_compact(F.array(*[F.when(owned(p) & _matches(p), F.lit(p.name)) for p in parsers]))
    hit = lines.select(*PLACE, F.explode(flags).alias("parser"))
    owner = parsed.claims.withColumnRenamed("parser", "owner")
    hit = hit.join(owner, PLACE, "left")
    return hit.groupBy("file_path", "parser").agg(
        F.count("*").alias("matched"), F.count_if(F.col("owner") == F.col("parser")).alias("claimed"), F.count_if(F.col("owner") != F.col("parser")).alias("shadowed")
    )
