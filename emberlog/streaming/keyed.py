"""Span pairing as a keyed stateful operator: one state a (file, outermost parser, its reference), beside the batch fold.

The operator walks the marks of its key in line order and keeps the open spans of the key, nested ones too, between batches. It
takes a batch's lines as they come and moves only matched ones, and only keys that a batch touches cost anything; the batch fold reads all open
spans at every batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberlog.functions.config import Parser
from emberlog.operators.chain import FOUND
from emberlog.operators.onepass import event_id_of, matched, rules_of

OUT = "file_path string, byte_offset long, id string, event_type string, name string, at_us long, duration_ms long, parent_id string, data string, raw_line string"
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


@dataclass(frozen=True)
class Step:
    """What a rule needs at run time: its role, its parser by number, the parsers around it, and how many reference values each has."""

    role: str
    name: str
    number: int
    around: tuple[tuple[int, int], ...]
    raw: bool


class OpenSpans(StatefulProcessor):
    """The open spans of a key as one JSON value: [parser number, reference values, id, microseconds, data, raw line] each."""

    def __init__(self, steps: list[Step], outermost: bool, ttl_ms: int | None) -> None:
        self.steps, self.outermost, self.ttl_ms = steps, outermost, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "spans string", *([self.ttl_ms] if self.ttl_ms else []))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = json.loads(self.state.get()[0]) if self.state.exists() else []
        spans = {(n, tuple(ref)): start for n, ref, *start in held}
        out = []
        marks = sorted((r for df in rows for r in df.itertuples(index=False)), key=lambda r: r.byte_offset)
        for r in marks:
            step, ref = self.steps[r.rule], tuple(json.loads(r.ref))
            at = None if pd.isna(r.at_us) else int(r.at_us)
            if step.role == "S":
                if at is not None:
                    spans.setdefault((step.number, ref), [r.id, at, r.data, r.raw_line])
                continue
            start = spans.pop((step.number, ref), None) if step.role == "E" else None
            if at is None or (step.role == "E" and start is None):
                continue
            around = [spans.get((n, ref[:size])) for n, size in step.around]
            if None in around:
                continue
            parent = around[0 if self.outermost else -1][0] if around else None
            place = [r.file_path, r.byte_offset]
            if step.role == "E":
                data = json.dumps({**json.loads(r.data), **json.loads(start[2])})
                took = (at - start[1]) // 1000 if at >= start[1] else -((start[1] - at) // 1000)
                out.append([*place, start[0], "span", step.name, start[1], took, parent, data, f"{start[3]}\n{r.raw_line}" if step.raw else None])
            else:
                out.append([*place, r.id, "single", step.name, at, None, parent, r.data, r.raw_line])
        if spans:
            self.state.update((json.dumps([[n, list(ref), *start] for (n, ref), start in spans.items()]),))
        else:
            self.state.clear()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        frame["duration_ms"] = frame["duration_ms"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def keyed_events(lines: DataFrame, parsers: list[Parser], parent_mode: str = "outermost", ttl_ms: int | None = None) -> DataFrame:
    """The events of a stream of lines, for parsers of which no line fits two (see onepass.overlaps).

    Batches must bring a file's lines in order. ttl_ms: an open span that nothing touches for so long is forgotten; by default none is. Runs
    with the RocksDB state store (see start_keyed).
    """
    rules, every, _ = rules_of(parsers)
    size = [len(p.fields) for p in every]
    steps = [Step(r.role, r.parser.name, r.number, tuple((n, size[n]) for n in r.around), r.parser.include_raw) for r in rules]
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)
    top = [(*r.around, r.number)[0] for r in rules]
    rows = matched(lines, parsers).withColumn("id", event_id_of(pick([r.parser.name for r in rules])))
    alone = [k for k, r in enumerate(rules) if r.role == "single" and not r.around]
    single = rows.where(F.col("rule").isin(alone) & F.col("timestamp").isNotNull()).select(
        *FOUND[:3], F.lit("single").alias("event_type"), pick([r.parser.name for r in rules]).alias("name"), "timestamp", F.lit(None).cast("long").alias("duration_ms"),
        F.lit(None).cast("string").alias("parent_id"), "data", "raw_line",
    )
    if len(alone) == len(rules):
        return single
    ref = F.coalesce(*[F.when(F.col("rule") == k, F.array(*[F.col("data")[f] for f in r.parser.fields])) for k, r in enumerate(rules) if k not in alone])
    marks = rows.where(~F.col("rule").isin(alone)).select(
        "file_path", pick(top).alias("top"), F.to_json(F.slice(ref, F.lit(1), pick([size[t] for t in top]))).alias("outer_ref"), "byte_offset", "rule", F.to_json(ref).alias("ref"), "id",
        F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, timestamp)").alias("at_us"), F.to_json("data").alias("data"), "raw_line",
    )
    spans = marks.groupBy("file_path", "top", "outer_ref").transformWithStateInPandas(
        statefulProcessor=OpenSpans(steps, parent_mode == "outermost", ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )
    spans = spans.withColumn("timestamp", F.expr(f"timestampadd(MICROSECOND, at_us, {_EPOCH})")).withColumn("data", F.from_json("data", "map<string,string>"))
    return single.unionByName(spans.select(*FOUND)) if alone else spans.select(*FOUND)


def start_keyed(lines: DataFrame, parsers: list[Parser], root: str, parent_mode: str = "outermost", ttl_ms: int | None = None, **trigger) -> StreamingQuery:
    """Start the stream; events are in root/events, the checkpoint with the open spans beside them.

    With ttl_ms Spark makes batches for the clock alone, so a stream of what is available would never end: the trigger is then a
    processing time (a second by default).
    """
    if ttl_ms and {"availableNow", "once"} & set(trigger):
        raise ValueError("a stream with a time to live needs a processingTime trigger")
    trigger = trigger or ({"processingTime": "1 second"} if ttl_ms else {"availableNow": True})
    spark, setting = lines.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = keyed_events(lines, parsers, parent_mode, ttl_ms)
        return events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/checkpoint").trigger(**trigger).start()
    finally:
        spark.conf.set(setting, before)
