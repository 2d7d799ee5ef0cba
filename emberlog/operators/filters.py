"""The filter DSL: comparisons on event columns that compile to one Spark predicate, so they reach the scan."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORDER = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v}


class Expr:
    """A checked comparison or combination; its column is made when it is asked for, so none needs a session before."""

    def __init__(self, make: Callable[[], Column], op: str = "cmp", parts: list["Expr"] | None = None) -> None:
        self.make, self.op, self.parts = make, op, parts or []

    @property
    def column(self) -> Column:
        return self.make()


def _like(column: Column, pattern: str, case_sensitive: bool) -> Column:
    pattern = pattern.replace("\\", "\\\\")
    return column.like(pattern) if case_sensitive else column.ilike(pattern)


def _compare(column: Callable[[], Column], op: str, value, text: Callable[[], Column] | None = None, cast: str = "string", case_sensitive: bool = False) -> Expr:
    if op == "like":
        if text is None:
            raise ValueError("like isn't allowed here")
        return Expr(lambda: _like(text(), value, case_sensitive))
    if op == "in":
        return Expr(lambda: column().isin([F.lit(v).cast(cast) for v in value]) if value else F.lit(False))
    if op not in _ORDER:
        raise ValueError(f"unknown comparison {op!r}")
    return Expr(lambda: _ORDER[op](column(), F.lit(value).cast(cast)))


def _text(field: str) -> Callable[[], Column]:
    return lambda: F.col(field)


def name(op: str, value, **kw) -> Expr:
    return _compare(_text("name"), op, value, _text("name"), **kw)


def event_id(op: str, value, **kw) -> Expr:
    return _compare(_text("id"), op, value, _text("id"), **kw)


def parent_id(op: str, value, **kw) -> Expr:
    return _compare(_text("parent_id"), op, value, _text("parent_id"), **kw)


def timestamp(op: str, value, **kw) -> Expr:
    return _compare(_text("timestamp"), op, value, lambda: F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), cast="timestamp_ntz", **kw)


def duration(op: str, value) -> Expr:
    """Milliseconds; single events have none and never match."""
    return _compare(_text("duration_ms"), op, value, None, cast="long")


def data(field: str, op: str, value: str, case_sensitive: bool = False) -> Expr:
    """A payload field, eq or like; an event without the field doesn't match."""
    if op not in ("eq", "like"):
        raise ValueError(f"{op!r} isn't allowed on data fields")
    return _compare(lambda: F.col("data")[field], op, value, lambda: F.col("data")[field], case_sensitive=case_sensitive)


def and_(parts: list[Expr]) -> Expr:
    if not parts:
        raise ValueError("and_ of nothing")
    return Expr(lambda: reduce(lambda a, b: a & b, [p.column for p in parts]), "and", parts)


def or_(parts: list[Expr]) -> Expr:
    if not parts:
        raise ValueError("or_ of nothing")
    return Expr(lambda: reduce(lambda a, b: a | b, [p.column for p in parts]), "or", parts)


class Filter:
    """A chain of AND-ed expressions; without one every row passes."""

    def __init__(self, expr: Expr | None = None) -> None:
        self.expr = expr

    def _with(self, more: Expr) -> "Filter":
        root = [] if self.expr is None else [self.expr]
        if any(x.op == "or" for x in root):
            raise ValueError("a filter of alternatives takes no further condition; put them in and_()")
        return Filter(and_([*root, more]) if root else more)

    def with_name(self, *a, **k) -> "Filter":
        return self._with(name(*a, **k))

    def with_id(self, *a, **k) -> "Filter":
        return self._with(event_id(*a, **k))

    def with_parent_id(self, *a, **k) -> "Filter":
        return self._with(parent_id(*a, **k))

    def with_timestamp(self, *a, **k) -> "Filter":
        return self._with(timestamp(*a, **k))

    def with_duration(self, *a) -> "Filter":
        return self._with(duration(*a))

    def with_data(self, *a, **k) -> "Filter":
        return self._with(data(*a, **k))

    def column(self) -> Column:
        return F.lit(True) if self.expr is None else self.expr.column

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.column())


def kind_filter(kind: str | None) -> Column:
    return F.col("event_type") == kind if kind in ("span", "single") else F.lit(True)


def name_contains(text: str | None) -> Column:
    """Blank: no filter. The caller's % and _ stay wildcards."""
    text = (text or "").strip()
    return _like(F.col("name"), f"%{text}%", False) if text else F.lit(True)
