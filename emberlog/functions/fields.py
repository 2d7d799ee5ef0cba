"""Columns made from a line: named captures, timestamps, event identifiers."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.patterns import STRPTIME, Pattern
from emberlog.functions.times import strptime


def timestamp(text: Column, java_format: str | None) -> Column:
    """The whole text as a zone-less timestamp; null if it doesn't parse or the format has no time of day."""
    if java_format is None:
        return F.lit(None).cast("timestamp_ntz")
    if java_format.startswith(STRPTIME):
        return strptime(text, java_format.removeprefix(STRPTIME))
    return F.try_to_timestamp(text, F.lit(java_format)).cast("timestamp_ntz")


def short_date(text: Column) -> Column:
    """Ten characters are a date at midnight, anything else a date and time."""
    return F.when(F.length(text) == 10, timestamp(F.concat(text, F.lit(" 00:00:00")), "y-M-d H:m:s")).otherwise(timestamp(text, "y-M-d H:m:s"))


def captures(line: Column, pattern: Pattern) -> Column:
    """Map of the named groups that took part in the first match; an absent optional group has no key. Null if no match."""
    if not pattern.groups:
        return F.when(line.rlike(pattern.java), F.create_map().cast("map<string,string>"))
    if not pattern.optional:
        pairs = [x for name, k in pattern.groups.items() for x in (F.lit(name), F.regexp_extract(line, pattern.java, k))]
        found = F.create_map(*pairs)
        if pattern.solid:  # no group matches the empty text, so an empty capture is an absent group
            found = F.map_filter(found, lambda _, v: v != "")
        return F.when(line.rlike(pattern.java), found)
    source = pattern.python

    @F.pandas_udf("map<string,string>")
    def search(lines: pd.Series) -> pd.Series:
        found = (regex.search(source, x) if x is not None else None for x in lines)
        return pd.Series([m and {k: v for k, v in m.groupdict().items() if v is not None} for m in found], dtype=object)

    return search(line)


def event_id(parser: str | Column, file_path: Column, byte_offset: Column) -> Column:
    """The same for the same line in every run: an MD5 in the usual 8-4-4-4-12 form."""
    h = F.md5(F.concat_ws("|", parser if isinstance(parser, Column) else F.lit(parser), file_path, byte_offset.cast("string")))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def sorted_json(data: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(data))))
