"""Event trees: paths from the roots, waterfalls and folded stacks, by pointer doubling. Orphans and cycles never start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from emberlog.sources.scratch import discard, written

_OWN = ["id", "parent_id", "name", "timestamp", "duration_ms", "event_type"]


def _jump(rows: DataFrame) -> DataFrame:
    """Rows whose ancestor is a root take its root, the others their ancestor's ancestor; what has no ancestor row goes."""
    above = rows.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("root_id").alias("its_root"), F.col("depth").alias("more"), F.col("path").alias("before"), F.col("root_at").alias("its_at"))
    going = rows.where("above is not null").join(above, "above")
    going = going.withColumns({"depth": F.col("depth") + F.col("more"), "path": F.concat("before", "path"), "root_id": F.col("its_root"), "root_at": F.col("its_at"), "above": F.col("next")})
    return rows.where("above is null").unionByName(going.select(*rows.columns))


def tree_paths(events: DataFrame, root_id: str | None = None, paths: bool = True) -> DataFrame:
    """root_id, id, parent_id, depth and path (names from the root) of every event under a root, or under one event.

    Each event points to an ancestor and holds the names on the way; a round replaces the pointer by the ancestor's own,
    twice, so a tree of depth d takes log4(d) rounds, each one join of a written table with itself. A round in which no event reaches
    its root is the last: what is left then is in a cycle or hangs under one. Of rows that share an id the earliest counts
    (of those, the least by name and parent); rows without an id are left out. paths=False leaves the paths null: they add up to
    the square of a chain's length.
    """
    least = F.min(F.struct("timestamp", "name", "parent_id", "duration_ms", "event_type"))
    base = events.where("id is not null").groupBy("id").agg(least.alias("e")).select("id", "e.*").select(*_OWN)
    above = F.col("parent_id") if root_id is None else F.when(F.col("id") != root_id, F.coalesce("parent_id", F.lit("")))
    root = lambda c: F.when(above.isNull(), F.col(c))
    rows = base.select(*_OWN, above.alias("above"), root("id").alias("root_id"), F.lit(0).alias("depth"), (F.array("name") if paths else F.lit(None).cast("array<string>")).alias("path"), root("timestamp").alias("root_at"))
    rows = written(rows.withColumn("depth", F.when(F.col("above").isNull(), 0).otherwise(1)), "tree")
    reached = -1
    while True:
        seen = Observation()
        following = written(_jump(_jump(rows)).observe(seen, F.count_if(F.col("above").isNull()).alias("reached"), F.count("*").alias("all")), "tree")
        discard(rows)
        rows, before, found = following, reached, seen.get
        reached = found["reached"]
        if reached in (before, found["all"]):
            break
    return rows.where("above is null").select("root_id", *_OWN, "depth", "path", "root_at")


def waterfall(events: DataFrame, root_id: str | None = None) -> DataFrame:
    found = tree_paths(events, root_id=root_id)
    return found.select("root_id", "id", "name", "depth", F.expr("timestampdiff(MILLISECOND, root_at, timestamp)").alias("start_offset_ms"), "duration_ms")


def folded(events: DataFrame) -> DataFrame:
    """stack, self_ms: a span's time without that of its child spans, never below 0, added up by path."""
    spans = tree_paths(events).where("event_type = 'span'")
    inner = spans.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sum("duration_ms").alias("inner_ms"))
    own = F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("inner_ms", F.lit(0)))
    return spans.join(inner, "id", "left").groupBy(F.array_join("path", ";").alias("stack")).agg(F.sum(own).cast("long").alias("self_ms"))
