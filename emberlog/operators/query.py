"""Reading events: newest-first pages, row and detail views, combined search."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.filters import Filter, kind_filter, name_contains
from emberlog.operators.metrics import with_level

PAGE = 50


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), "id")


def page(events: DataFrame, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page with has_more on each row. One row more than the page is fetched instead of counting all."""
    number = max(1, number)
    rows = newest_first(events).offset((number - 1) * size).limit(size + 1)
    return rows.withColumn("has_more", F.count("*").over(_whole()) > size).orderBy(F.desc("timestamp"), "id").limit(size)


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # a page and one row


def page_by_range(events: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """The page of page(), for deep pages: counts by day, then by second of the first and last day that the page touches, show
    the page's range of time; only rows of that range are read, sorted and cut. Rows without a time come last, as in page().

    Best over a stored table, where the range reaches the scan. The driver gets a row a day, and a row a second of two days.
    """
    first = (max(1, number) - 1) * size
    skipped, touched = _touched(_units(events, "day"), first, first + size)
    if not touched:
        return events.limit(0).withColumn("has_more", F.lit(False))
    ends = [u for u in {touched[0], touched[-1]} if u[0] is not None]
    finer = _units(events.where(reduce(lambda a, b: a | b, [_within([u]) for u in ends])), "second") if ends else []
    inside = lambda day: [u for u in finer if day[0] <= u[0] < day[1]]
    units = [x for u in touched for x in (inside(u) if u in ends else [u])]
    more, touched = _touched(units, first - skipped, first - skipped + size)
    rows = newest_first(events.where(_within(touched))).offset(first - skipped - more).limit(size + 1)
    return rows.withColumn("has_more", F.count("*").over(_whole()) > size).orderBy(F.desc("timestamp"), "id").limit(size)


def _units(events: DataFrame, unit: str) -> list[tuple[datetime | None, datetime | None, int]]:
    """Start, end and count of each unit of time, newest first; rows without a time are one without start and end."""
    at = F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("at")
    counts = events.groupBy(at).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect()
    step = timedelta(**{f"{unit}s": 1})
    return [(r["at"], r["at"] and r["at"] + step, r["n"]) for r in counts]


def _touched(units: list[tuple], first: int, last: int) -> tuple[int, list[tuple]]:
    """How many rows come before the units that hold the rows first..last, and these units."""
    ends = list(accumulate(n for _, _, n in units))
    found = [k for k, end in enumerate(ends) if end > first and end - units[k][2] <= last]
    return (ends[found[0]] - units[found[0]][2], [units[k] for k in found]) if found else (0, [])


def _within(units: list[tuple]) -> Column:
    timed = [u for u in units if u[0] is not None]
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    found = (F.col("timestamp") >= at(timed[-1][0])) & (F.col("timestamp") < at(timed[0][1])) if timed else F.lit(False)
    return found | F.col("timestamp").isNull() if len(timed) < len(units) else found


def page_after(events: DataFrame, timestamp: datetime, last_id: str, size: int = PAGE) -> DataFrame:
    """The page after a row: deep pages cost no more than the first."""
    at = F.lit(timestamp).cast("timestamp_ntz")
    return newest_first(events.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") > last_id)))).limit(size)


def rows_view(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("event_type").alias("kind"), "name", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("shown_at"), "duration_ms")


def detail(events: DataFrame, id_: str | None = None) -> DataFrame:
    """Payload entries by key of an event (or of each event), with the raw lines as `start - end`."""
    rows = events if id_ is None else events.where(F.col("id") == id_)
    shown = F.when((F.col("event_type") == "span") & (F.instr("raw_line", "\n") > 0), F.concat(F.substring_index("raw_line", "\n", 1), F.lit(" - "), F.expr("substring(raw_line, instr(raw_line, '\n') + 1)")))
    rows = rows.select("id", F.coalesce(shown, F.col("raw_line")).alias("raw"), F.posexplode(F.array_sort(F.map_entries("data"))).alias("position", "entry"))
    return rows.select("id", "raw", "position", "entry.key", "entry.value")


def combined(events: DataFrame, now: datetime, since: timedelta, name: str | None = None, kind: str | None = None, level: str | None = None, filter_: Filter | None = None) -> DataFrame:
    rows = events.where((F.col("timestamp") >= F.lit(now - since).cast("timestamp_ntz")) & name_contains(name) & kind_filter(kind))
    rows = (filter_ or Filter()).apply(rows)
    return with_level(rows).where(F.col("level") == level.upper()) if level else rows


def full_text(events: DataFrame, terms: list[str]) -> DataFrame:
    """Events whose raw line has all terms, in any case."""
    for term in terms:
        events = events.where(F.contains(F.lower("raw_line"), F.lit(term.lower())))
    return events


def saved_searches(events: DataFrame, searches: dict[str, Filter]) -> DataFrame:
    """search, n: all searches in one scan."""
    counts = events.agg(*[F.count_if(f.column()).alias(f"c{k}") for k, f in enumerate(searches.values())])
    pairs = ", ".join(f"'{n}', c{k}" for k, n in enumerate(searches))
    return counts.selectExpr(f"stack({len(searches)}, {pairs}) as (search, n)")
