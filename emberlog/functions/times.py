"""Time formats that Spark's patterns can't say: two-digit years, epoch seconds, offsets, weekdays, days of the year."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month and weekday names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Strftime directives that are read here, with what they stand for.
SAME = {"%F": "%Y-%m-%d", "%T": "%H:%M:%S", "%R": "%H:%M", "%D": "%m/%d/%y", "%h": "%b", "%e": "%d", "%k": "%H", "%l": "%I", "%P": "%p", "%A": "%a", "%B": "%b"}
_NAME = lambda names: "|".join(f"{n[:3]}(?:{n[3:]})?" for n in names)
PIECES = {
    "%Y": r"(?P<year>\d{1,4})", "%y": r"(?P<short>\d{1,2})", "%m": r"(?P<month>\d{1,2})", "%b": f"(?P<monthname>{_NAME(MONTHS)})", "%d": r"\s?(?P<day>\d{1,2})", "%j": r"(?P<yearday>\d{1,3})",
    "%a": f"(?P<weekday>{_NAME(WEEKDAYS)})", "%H": r"\s?(?P<hour>\d{1,2})", "%I": r"\s?(?P<half>\d{1,2})", "%p": "(?P<noon>[ap]m)", "%M": r"(?P<minute>\d{1,2})", "%S": r"(?P<second>\d{1,2})",
    "%.f": r"(?:\.(?P<fraction>\d{1,9}))?", "%f": r"(?P<fraction>\d{1,9})", "%s": r"(?P<epoch>-?\d{1,12})", "%z": r"(?:[+-]\d{2}:?\d{2}|[zZ])", "%:z": r"(?:[+-]\d{2}:\d{2}|[zZ])", "%Z": r"\S+", "%%": "%",
}
DIRECTIVE = re.compile(r"%\.f|%:z|%.")


def format_pattern(fmt: str) -> str | None:
    """A regular expression for the whole text of a format, or None if it has a directive that isn't read."""
    for short, long in SAME.items():
        fmt = fmt.replace(short, long)
    out, at = [], 0
    for m in DIRECTIVE.finditer(fmt):
        if m[0] not in PIECES:
            return None
        out += [re.escape(fmt[at : m.start()]), PIECES[m[0]]]
        at = m.end()
    return "(?i)" + "".join(out) + re.escape(fmt[at:])


def complete(pattern: str) -> bool:
    """Whether the fields make a date and a time of day."""
    has = set(re.findall(r"\(\?P<(\w+)>", pattern))
    date = has & {"year", "short"} and (("yearday" in has) or (has & {"month", "monthname"} and "day" in has))
    return "epoch" in has or bool(date and ("hour" in has or {"half", "noon"} <= has) and "minute" in has)


def parse_times(texts: pd.Series, pattern: str) -> pd.Series:
    """Zone-less times of whole texts; NaT for any other text or an impossible time. An offset is read over. A two-digit year below 70 is
    of this century; a weekday must be the date's."""
    anchored = re.compile(f"^(?:{pattern.removeprefix('(?i)')})$", re.I)
    found = texts.fillna("\0").str.extract(anchored, expand=True)
    fits = texts.fillna("\0").str.match(anchored)
    none = pd.Series(np.nan, texts.index)
    number = lambda name: pd.to_numeric(found[name], errors="coerce") if name in found else none
    named = lambda name, names: found[name].str.lower().str[:3].map({n[:3]: k for k, n in enumerate(names)}) if name in found else none
    if "epoch" in found:
        return pd.to_datetime(number("epoch").where(fits), unit="s", errors="coerce").astype("datetime64[us]")
    year = number("year").fillna(number("short") + np.where(number("short") < 70, 2000, 1900))
    hour = number("hour")
    if "half" in found and "noon" in found:
        half = number("half").where(lambda h: (h >= 1) & (h <= 12))
        hour = hour.fillna(half % 12 + 12 * (found["noon"].str.lower() == "pm"))
    month, day = number("month").fillna(named("monthname", MONTHS) + 1), number("day")
    ahead = number("yearday").where(lambda d: (d >= 1) & (d <= 365 + (((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0))))
    by_day = "yearday" in found
    good = fits & (hour <= 23) & (number("minute") <= 59) & (number("second").fillna(0) <= 59) & year.notna() & (ahead.notna() if by_day else month.notna() & day.notna())
    parts = pd.DataFrame({"year": year, "month": 1 if by_day else month, "day": 1 if by_day else day}).where(good)
    date = pd.to_datetime(parts, errors="coerce")
    date = date + pd.to_timedelta(ahead - 1, unit="D") if by_day else date
    if "weekday" in found:
        date = date.where(named("weekday", WEEKDAYS) == date.dt.weekday)
    micros = (found["fraction"].str.ljust(9, "0").str[:6] if "fraction" in found else none).astype(float).fillna(0)
    seconds = hour * 3600 + number("minute") * 60 + number("second").fillna(0)
    return (date + pd.to_timedelta(seconds, unit="s") + pd.to_timedelta(micros, unit="us")).astype("datetime64[us]")


def strptime(text: Column, fmt: str) -> Column:
    """The whole text by a format of PIECES, in Arrow batches."""
    pattern = format_pattern(fmt)

    @F.pandas_udf("timestamp_ntz")
    def parse(texts: pd.Series) -> pd.Series:
        return parse_times(texts, pattern)

    return parse(text)
