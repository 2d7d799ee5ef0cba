"""A chain whose patterns never match the same line: each line is matched once, and all parsers share a window a level.

The fold of parse_logs scans the lines again for each parser, as what a parser claims depends on state. If no line fits two
patterns of a file, claims don't matter: the source is read once, whatever the number of parsers, and what matched is
written with its rule and captures. Events, open spans, claims and diagnostics all come from that table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.config import Parser
from emberlog.functions.fields import captures, event_id, timestamp
from emberlog.functions.patterns import Pattern
from emberlog.operators.chain import FOUND, PENDING, PLACE, Parsed, owned
from emberlog.operators.state import span_state
from emberlog.sources.scratch import written


@dataclass(frozen=True)
class Rule:
    """One pattern: its parser, what a match marks (single, S or E), and the span parsers around it by number, outermost first."""

    parser: Parser
    role: str
    pattern: Pattern
    number: int
    around: tuple[int, ...]


def rules_of(parsers: list[Parser]) -> tuple[list[Rule], list[Parser], list[int | None]]:
    """All patterns of a configuration; all parsers by number, and the number of the parser around each."""
    rules: list[Rule] = []
    every: list[Parser] = []
    outer: list[int | None] = []

    def walk(parser: Parser, around: tuple[int, ...]) -> None:
        number = len(every)
        every.append(parser)
        outer.append(around[-1] if around else None)
        if parser.kind == "single":
            rules.append(Rule(parser, "single", parser.pattern, number, around))
            return
        rules.extend(Rule(parser, role, pattern, number, around) for role, pattern in (("S", parser.start), ("E", parser.end)))
        for nested in parser.nested:
            walk(nested, (*around, number))

    for parser in parsers:
        walk(parser, ())
    return rules, every, outer


def literal(pattern: str) -> str:
    """The longest text that every match of a pattern holds, as far as plain reading shows; empty if nothing is sure."""
    if re.match(r"\(\?[a-z]", pattern) or "|" in re.sub(r"\\.|\[[^\]]*\]|\([^()]*\)", "", pattern):
        return ""
    best, run, depth = "", "", 0
    tokens = re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|\(\?P<\w+>|\(\?:|\{[^}]*\}|.", pattern, re.S)
    for token, following in zip(tokens, [*tokens[1:], ""]):
        depth += token[0] == "("
        plain = depth == 0 and len(token) == 1 and token not in ".^$*+?()[]{}|\\" and following not in ("?", "*") and following[:1] != "{"
        run = run + token if plain else ""
        best = max(best, run, key=len)
        depth -= token == ")"
    return best


def _fits(rule: Rule, top: Parser) -> Column:
    sure = literal(rule.pattern.python)
    return owned(top) & (F.contains("line", F.lit(sure)) if sure else F.lit(True)) & F.col("line").rlike(rule.pattern.java)


def _choose(values: list, by: str) -> Column:
    """values[by] for a column of small numbers."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(by) + 1)


def matched(lines: DataFrame, parsers: list[Parser]) -> DataFrame:
    """file_path, byte_offset, rule, data, timestamp, raw_line of every line that fits a pattern; a narrow pass."""
    rules, every, _ = rules_of(parsers)
    tops = {id(every[(*r.around, r.number)[0]]): every[(*r.around, r.number)[0]] for r in rules}
    top = lambda r: tops[id(every[(*r.around, r.number)[0]])]
    hit = F.coalesce(*[F.when(_fits(r, top(r)), F.lit(k)) for k, r in enumerate(rules)])
    rows = lines.select(*PLACE, "line", hit.alias("rule")).where("rule is not null")
    by_rule = lambda make: F.coalesce(*[F.when(F.col("rule") == k, make(r)) for k, r in enumerate(rules)])
    rows = rows.withColumn("data", by_rule(lambda r: captures(F.col("line"), r.pattern)))
    rows = rows.withColumn("timestamp", by_rule(lambda r: timestamp(F.col("data")["timestamp"], r.parser.time_format)))
    return rows.select(*PLACE, "rule", "data", "timestamp", F.when(by_rule(lambda r: F.lit(r.parser.include_raw)), F.col("line")).alias("raw_line"))


def overlaps(lines: DataFrame, parsers: list[Parser]) -> DataFrame:
    """file_path, first, second, n: lines that fit patterns of two parsers, so that a chain isn't disjoint. No rows: it is."""
    rules, every, _ = rules_of(parsers)
    names = F.array_compact(F.array(*[F.when(_fits(r, every[(*r.around, r.number)[0]]), F.lit(f"{r.parser.name} {r.role}")) for r in rules]))
    rows = lines.select("file_path", names.alias("fits")).where(F.size("fits") > 1)
    return rows.groupBy("file_path", F.col("fits")[0].alias("first"), F.col("fits")[1].alias("second")).agg(F.count("*").alias("n"))


def parse_disjoint(lines: DataFrame, parsers: list[Parser], pending_in: DataFrame | None = None, parent_mode: str = "outermost", chunk: int | None = None) -> Parsed:
    """As parse_logs, for patterns of which no line fits two; see overlaps. The lines are read once, when this is called."""
    found = written(matched(lines, parsers), "matched")
    return paired(found, parsers, pending_in, parent_mode, chunk)


def paired(found: DataFrame, parsers: list[Parser], pending_in: DataFrame | None = None, parent_mode: str = "outermost", chunk: int | None = None) -> Parsed:
    """Events, open spans, diagnostics and claims of matched lines. All span parsers of one depth share one window."""
    rules, every, outer = rules_of(parsers)
    names, none = [p.name for p in every], F.lit(None)
    tops = [(*r.around, r.number)[0] for r in rules]
    depth = [len(r.around) + (r.role != "single") for r in rules]  # of the span whose state the row meets; 0: none
    owner = [r.number if r.role != "single" else r.around[-1] if r.around else -1 for r in rules]
    ref = F.coalesce(*[F.when(F.col("rule") == k, F.array(*[F.col("data")[f] for f in r.parser.fields]).cast("array<string>")) for k, r in enumerate(rules)])
    name = _choose([r.parser.name for r in rules], "rule")
    role = _choose([r.role for r in rules], "rule")
    rows = found.select(
        *PLACE, "rule", "timestamp", "data", "raw_line", event_id_of(name).alias("id"), ref.alias("ref"), F.when(role == "single", "N").otherwise(role).alias("kind"),
        _choose(depth, "rule").alias("depth"), _choose(owner, "rule").alias("owner"), F.when(role == "single", "single").alias("event_type"), name.alias("name"),
        none.cast("long").alias("duration_ms"), none.cast("string").alias("parent_id"),
    )
    bad = rows.where("timestamp is null").select("file_path", F.col("name").alias("parser"), F.lit("bad timestamp").alias("reason"))
    rows = rows.where("timestamp is not null or kind = 'E'")
    alone = rows.where("depth = 0")
    events, pending, diagnostics = [alone.select(*FOUND)], [], [bad]
    claims = [alone.select(*PLACE, _choose([names[t] for t in tops], "rule").alias("parser"))]
    columns = [*PLACE, "owner", "ref", "kind", "id", "timestamp", "data", "raw_line", "event_type", "name", "duration_ms", "parent_id"]
    deepest, inner = max(depth, default=0), None
    level_of = {r.number: len(r.around) + 1 for r in rules if r.role == "S"}
    for level in range(deepest, 0, -1):
        marks = rows.where(F.col("depth") == level).select(*columns)
        # A nested row may hold the fields of deeper spans; its key has those of the span around it.
        marks = marks.withColumn("ref", F.slice("ref", F.lit(1), _choose([len(p.fields) for p in every], "owner")))
        marks = marks if inner is None else marks.unionByName(inner)
        own = [k for k, at in level_of.items() if at == level]
        if pending_in is not None:
            number = F.coalesce(*[F.when(F.col("parser_name") == names[k], F.lit(k)) for k in own])
            restored = pending_in.withColumn("owner", number).where("owner is not null").select(
                "file_path", F.lit(-1).cast("long").alias("byte_offset"), "owner", F.col("span_ref").alias("ref"), F.lit("S").alias("kind"), "id", "timestamp", "data", "raw_line",
                none.cast("string").alias("event_type"), none.cast("string").alias("name"), none.cast("long").alias("duration_ms"), "parent_id",
            )
            marks = marks.unionByName(restored)
        marks = span_state(marks, ["file_path", "owner", "ref"], chunk)
        start, end = F.col("start"), F.col("kind") == "E"
        merged = F.map_concat(F.map_filter("data", lambda k, _: ~F.map_contains_key(start["data"], k)), start["data"])
        either = lambda span, nested: F.when(end, span).otherwise(nested)
        parent = start["id"] if parent_mode == "outermost" else F.coalesce("parent_id", start["id"])
        raw = F.when(_choose([p.include_raw for p in every], "owner"), F.concat_ws("\n", start["raw_line"], F.col("raw_line")))
        done = marks.where("before = 'S' and (kind = 'N' or (kind = 'E' and timestamp is not null))").select(
            *PLACE, "owner", "ref", F.lit("N").alias("kind"), either(start["id"], F.col("id")).alias("id"), either(start["timestamp"], F.col("timestamp")).alias("timestamp"), either(merged, F.col("data")).alias("data"),
            either(raw, F.col("raw_line")).alias("raw_line"), either(F.lit("span"), F.col("event_type")).alias("event_type"), either(_choose(names, "owner"), F.col("name")).alias("name"),
            either(F.expr("timestampdiff(MILLISECOND, start.timestamp, timestamp)"), F.col("duration_ms")).alias("duration_ms"), either(none.cast("string"), parent).alias("parent_id"),
        )
        named = _choose(names, "owner")
        if level == 1:
            events.append(done.select(*FOUND))
            claims += [done.select(*PLACE, named.alias("parser")), marks.where("opens and byte_offset >= 0").select(*PLACE, named.alias("parser"))]
        else:
            around = [-1 if k is None else k for k in outer]
            inner = done.withColumn("owner", _choose(around, "owner")).withColumn("ref", F.slice("ref", F.lit(1), _choose([len(p.fields) for p in every], "owner"))).select(*columns)
        diagnostics.append(marks.where("kind = 'S' and not opens").select("file_path", named.alias("parser"), F.lit("duplicate start").alias("reason")))
        opened = F.struct("id", "timestamp", "data", "raw_line")
        last = marks.where("kind <> 'N'").groupBy("file_path", "owner", "ref").agg(F.max_by("kind", "byte_offset").alias("kind"), F.max_by(opened, F.when(F.col("opens"), F.col("byte_offset"))).alias("start"))
        pending.append(last.where("kind = 'S'").select("file_path", named.alias("parser_name"), F.col("ref").alias("span_ref"), "start.id", "start.timestamp", "start.data", none.cast("string").alias("parent_id"), "start.raw_line"))
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    counts = union(diagnostics).groupBy("file_path", "parser", "reason").agg(F.count("*").alias("n"))
    return Parsed(union(events), union(pending or [found.sparkSession.createDataFrame([], PENDING)]), counts, union(claims))


def event_id_of(name: Column) -> Column:
    return event_id(name, *map(F.col, PLACE))
