"""Alert rules, their history, silence windows, and events derived from pairs of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlog.operators.filters import Filter
from emberlog.sources.scratch import written


def matching(events: DataFrame, rules: dict[str, Filter]) -> DataFrame:
    """Events with the name of each rule that they meet, in one scan."""
    flags = F.array_compact(F.array(*[F.when(f.column(), F.lit(n)) for n, f in rules.items()]))
    return events.withColumn("rule", F.explode(flags))


def bursts(matches: DataFrame, more_than: int, minutes: int, keys: tuple[str, ...] = ("rule",)) -> DataFrame:
    """Matches at which more than so many of the same key came in the minutes before, this one included.

    Only the minutes' count is needed, so matches are first cut into buckets of that length; a row is also counted for the
    bucket after its own. A busy rule is so many partitions, not one.
    """
    seconds = minutes * 60
    rows = matches.withColumn("_s", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)")).withColumn("_b", F.floor(F.col("_s") / (seconds * 1_000_000)))
    rows = rows.withColumn("_in", F.explode(F.array("_b", F.col("_b") + 1)))
    frame = W.partitionBy(*keys, "_in").orderBy("_s").rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("recent", F.count("*").over(frame)).where((F.col("_in") == F.col("_b")) & (F.col("recent") > more_than)).drop("_s", "_b", "_in")


#: Cells of one level that make a cell of the next, in both hierarchies of time below.
FAN = 16
#: Levels of silence cells; the widest is longer than all of Spark's time.
LEVELS = 8
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def history(fired: DataFrame, minutes: int, keys: tuple[str, ...] = ("rule",), cell_minutes: int = 60) -> DataFrame:
    """Runs of firings with no gap beyond the minutes: fired_at, last_at, resolved_at, matched.

    Firings become segments (first, last, count) within cells of time; then FAN cells at a time are merged, and only a
    cell's first and last segment can still grow, so a window has 2 FAN rows at most after the first level. Levels end when one cell holds
    all of the time, after log(cells) of them.
    """
    us = F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, first_at)")
    rows = fired.select(*keys, F.col("timestamp").alias("first_at"), F.col("timestamp").alias("last_at"), F.lit(1).cast("long").alias("matched"))
    ends = rows.agg(F.min(us), F.max(us)).first()
    low, high = ends[0] or 0, ends[1] or 0
    width, done = cell_minutes * 60_000_000, []
    while True:
        cell = [*keys, F.floor((us - low) / width)]
        w = W.partitionBy(*cell).orderBy("first_at", "last_at")
        new = F.coalesce(F.expr(f"first_at > lag_at + interval {minutes} minutes"), F.lit(True)).cast("int")
        rows = rows.withColumn("lag_at", F.lag("last_at").over(w)).withColumn("run", F.sum(new).over(w)).withColumn("runs", F.max("run").over(W.partitionBy(*cell)))
        rows = rows.withColumn("cell", cell[-1]).groupBy(*keys, "cell", "run").agg(
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("matched").alias("matched"), F.max("runs").alias("runs")
        )
        last = width > high - low
        closed = F.lit(True) if last else (F.col("run") > 1) & (F.col("run") < F.col("runs"))
        rows = written(rows.select(*keys, "first_at", "last_at", "matched", closed.alias("closed")), "alert-segments")
        done.append(rows.where("closed").drop("closed"))
        if last:
            break
        rows, width = rows.where("not closed").drop("closed"), width * FAN
    out = reduce(DataFrame.unionByName, done)
    return out.select(*keys, F.col("first_at").alias("fired_at"), "last_at", "matched", F.expr(f"last_at + interval {minutes} minutes").alias("resolved_at"))


def unsilenced(matches: DataFrame, silences: DataFrame) -> DataFrame:
    """Matches outside the silence windows (rule, start, stop) of their rule; a window holds its start and not its stop.

    A null stop is no end, a null start no beginning; a window that ends where it starts, or before, is none. Cells of level k are FAN^k hours; a
    window is entered at the first level where it touches FAN + 1 cells or fewer, however long it is. Matches meet the cells of one
    level after the other, of the few levels that windows use; small sides are broadcast by Spark's own size check, and AQE splits a
    long cell of a busy rule.
    """
    hours = lambda c, k: F.floor(F.expr(f"timestampdiff(SECOND, {_EPOCH}, {c})") / (3600 * FAN**k))
    start = F.coalesce("start", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    stop = F.coalesce("stop", F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))
    s = silences.select(F.col("rule").alias("_rule"), start.alias("_start"), stop.alias("_stop"), F.col("stop").isNull().alias("_open")).where("_start < _stop or _open")
    level = F.coalesce(*[F.when(hours("_stop", k) - hours("_start", k) <= FAN, F.lit(k)) for k in range(LEVELS)])
    s = written(s.withColumn("_level", level), "silences")
    for (k,) in sorted(s.select("_level").distinct().collect()):  # LEVELS at most
        cells = s.where(F.col("_level") == k).withColumn("_hour", F.explode(F.sequence(hours("_start", k), hours("_stop", k)))).withColumn("_key", F.concat_ws("|", "_rule", "_hour"))
        inside = (F.col("_at") == F.col("_key")) & (F.col("timestamp") >= F.col("_start")) & ((F.col("timestamp") < F.col("_stop")) | F.col("_open"))
        # Rule and hour are one key, which the optimiser can't take apart where the rule is a constant.
        matches = matches.withColumn("_at", F.concat_ws("|", "rule", hours("timestamp", k))).join(cells, inside, "left_anti").drop("_at")
    return matches


def queue_wait(events: DataFrame, first: str, then: str, ref: str, gap_ms: int) -> DataFrame:
    """For each span of one name, the nearest span of another (or the same) name and reference that starts within the gap after its end.

    The range is joined by time buckets of the gap, so each row meets its own bucket and the next.
    """
    spans = events.where("event_type = 'span'").withColumn("ref", F.col("data")[ref]).withColumn("start_ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', timestamp)"))
    a = spans.where(F.col("name") == first).select(F.col("id").alias("after_id"), "ref", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))
    a = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("end_ms") / (gap_ms + 1)), F.floor(F.col("end_ms") / (gap_ms + 1)) + 1)))
    b = spans.where(F.col("name") == then).select(F.col("id").alias("before_id"), "ref", "start_ms", F.floor(F.col("start_ms") / (gap_ms + 1)).alias("bucket"))
    met = a.join(b, ["ref", "bucket"]).where("start_ms between end_ms and end_ms + %d and before_id <> after_id" % gap_ms)
    nearest = met.groupBy("after_id", "ref").agg(F.min(F.struct((F.col("start_ms") - F.col("end_ms")).alias("wait_ms"), F.col("before_id"))).alias("n"))
    return nearest.select("after_id", "ref", "n.before_id", "n.wait_ms")
