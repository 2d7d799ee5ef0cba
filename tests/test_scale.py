"""The forms for large inputs against the plain ones."""

import random
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberlog.functions.fields import timestamp
from emberlog.functions.patterns import ConfigError, spark_time_format
from emberlog.functions.times import format_pattern, parse_times
from emberlog.jobs import registry
from emberlog.operators import alerts, metrics, query, tree
from emberlog.operators.chain import EVENT, parse_logs
from emberlog.operators.onepass import literal, overlaps
from emberlog.operators.state import span_state
from emberlog.sources.remote import listing, range_lines
from emberlog.sources.tail import TailReader
from emberlog.streaming.ingest import start_ingest
from emberlog.streaming.keyed import start_keyed
from tests.test_parsing import NESTED, SPAN, TS, at, config

DAY = datetime(2025, 3, 1)


def nested_text(rng, n, refs="ab"):
    out = []
    for k in range(n):
        mark, ref, job = rng.choice(["BEGUN", "DONE", "NOTE", "ON", "OFF", "LEAF", "other"]), rng.choice(refs), rng.choice("12")
        tail = f"SUB {job} {mark}" if mark in ("ON", "OFF") else f"LEAF {job}" if mark == "LEAF" else mark
        out.append(f"{at(k) if rng.random() > 0.1 else '2026-02-30 01:02:03'} {ref * 3} {tail}")
    return out


def lines_of(spark, text, start=0):
    return spark.createDataFrame([("f", start + k, x) for k, x in enumerate(text)], "file_path string, byte_offset long, line string")


def rows_of(events):
    return sorted((r.id, r.event_type, r.name, str(r.timestamp), r.duration_ms, r.parent_id, sorted(r.data.items()), r.raw_line) for r in events.collect())


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
def test_chunks_give_the_state_of_the_window(spark, chunk):
    rng = random.Random(chunk)
    rows = [("f", rng.choice("abb"), k, rng.choice(["S", "S", "E", "N", "N"]), f"{k}", DAY, {}, "x") for k in range(-1, 600)]
    marks = spark.createDataFrame(rows, "file_path string, ref string, byte_offset long, kind string, id string, timestamp timestamp_ntz, data map<string,string>, raw_line string")
    plain, cut = ({r.byte_offset: (r.before, r.opens, r.before == "S" and r.start.id) for r in span_state(marks, ["file_path", "ref"], c).collect()} for c in (None, chunk))
    assert plain == cut and any(s for _, _, s in cut.values())


@pytest.mark.parametrize("mode", ["outermost", "nearest"])
def test_one_pass_gives_the_events_of_the_fold(spark, mode):
    rng = random.Random(len(mode))
    other = {"name": "other", "type": "single", "glob": "*", "include_raw": False, "pattern": TS + r" (?P<ref>[a-z]{3}) other"}
    parsers = config(NESTED, other, {**SPAN, "name": "gone", "glob": "/not/here/*"})
    first, second = nested_text(rng, 200), nested_text(rng, 200)
    one, fold = (parse_logs(lines_of(spark, first), parsers, parent_mode=mode, chunk=40 if d else None, disjoint=d) for d in (True, False))
    pending = lambda p: sorted((r.parser_name, tuple(r.span_ref), r.id) for r in p.pending.collect())
    assert rows_of(one.events) == rows_of(fold.events) and pending(one) == pending(fold)
    assert sorted(map(tuple, one.diagnostics.collect())) == sorted(map(tuple, fold.diagnostics.collect()))
    assert sorted(map(tuple, one.claims.collect())) == sorted(map(tuple, fold.claims.collect()))
    again = [parse_logs(lines_of(spark, second, 200), parsers, fold.pending, parent_mode=mode, disjoint=d).events for d in (True, False)]
    assert rows_of(again[0]) == rows_of(again[1])


def test_overlaps_show_what_is_not_disjoint(spark):
    lines = lines_of(spark, [f"{at(1)} aaa BEGUN", f"{at(2)} aaa DONE", "no"])
    catch = {"name": "any", "type": "single", "glob": "*", "pattern": TS + " .*"}
    assert overlaps(lines, config(SPAN)).count() == 0
    assert sorted((r.first, r.second, r.n) for r in overlaps(lines, config(SPAN, catch)).collect()) == [("s E", "any single", 1), ("s S", "any single", 1)]


@pytest.mark.parametrize(
    "pattern, text", [(r"(?P<a>\d+)\s+LOG level=(?P<b>\w+)", "LOG level="), (r"(?i)LOG", ""), (r"abc|def", ""), (r"abcd?e", "abc"), (r"x(?:yy|zz)longer", "longer"), (r"[abc]\.b+", "b"), (r"ab{2}cde", "cde")]
)
def test_literals(pattern, text):
    assert literal(pattern) == text


def test_keyed_state_over_restarts(spark, tmp_path):
    """Nested spans that cross batches and a restart: the events of one batch fold."""
    rng = random.Random(8)
    text, parsers = nested_text(rng, 240, "abc"), config(NESTED)
    for k in range(2):
        for part in (2 * k, 2 * k + 1):
            lines_of(spark, text[60 * part : 60 * part + 60], 60 * part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("file_path string, byte_offset long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        start_keyed(stream, parsers, str(tmp_path / "out"), parent_mode="nearest").awaitTermination()
    found = spark.read.schema(EVENT).parquet(str(tmp_path / "out/events"))
    assert rows_of(found) == rows_of(parse_logs(lines_of(spark, text), parsers, parent_mode="nearest").events)


@pytest.mark.parametrize("ttl, spans", [(500, 0), (10**9, 1)])
def test_open_spans_may_be_forgotten(spark, tmp_path, ttl, spans):
    write = lambda k, mark: lines_of(spark, [f"{at(k)} aaa {mark}"], k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write(0, "BEGUN")
    stream = spark.readStream.schema("file_path string, byte_offset long, line string").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        start_keyed(stream, config(SPAN), str(tmp_path / "out"), ttl_ms=ttl, availableNow=True)
    running = start_keyed(stream, config(SPAN), str(tmp_path / "out"), ttl_ms=ttl)
    try:
        for k in (1, 2):
            until = time.time() + 60
            while len([p for p in running.recentProgress if p["numInputRows"]]) < k and time.time() < until:
                time.sleep(0.5)
            time.sleep(1)
            if k == 1:
                write(1, "DONE")
    finally:
        running.stop()
    assert spark.read.schema(EVENT).parquet(str(tmp_path / "out/events")).count() == spans


def test_old_open_spans_are_deleted(spark, tmp_path):
    rng = random.Random(9)
    text = nested_text(rng, 200)
    for part in range(4):
        lines_of(spark, text[50 * part : 50 * part + 50], 50 * part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file_path string, byte_offset long, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_ingest(stream, config(NESTED), str(tmp_path / "out"), disjoint=True).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "out/pending").glob("batch=*")) == ["batch=2", "batch=3"]
    assert rows_of(spark.read.parquet(str(tmp_path / "out/events"))) == rows_of(parse_logs(lines_of(spark, text), config(NESTED)).events)


def tree_rows(spark, pairs):
    return spark.createDataFrame([(i, "span", f"n{i}", DAY + timedelta(seconds=s), 1, p, {}, None) for i, p, s in pairs], EVENT)


def test_trees_end(spark):
    """A repeated id counts once, cycles and what hangs under them never start, and rows without an id are left out."""
    rows = [("a", None, 0), ("b", "a", 0), ("a", "b", 1), ("c", "d", 0), ("d", "c", 0), ("e", "c", 0), ("f", "f", 0), (None, "a", 0), ("g", "gone", 0), ("h", "b", 0)]
    got = {r.id: (r.root_id, r.depth, list(r.path)) for r in tree.tree_paths(tree_rows(spark, rows)).collect()}
    assert got == {"a": ("a", 0, ["na"]), "b": ("a", 1, ["na", "nb"]), "h": ("a", 2, ["na", "nb", "nh"])}
    assert {r.id for r in tree.tree_paths(tree_rows(spark, rows), "c").collect()} == {"c", "d", "e"}
    assert tree.tree_paths(tree_rows(spark, rows).limit(0)).count() == 0


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(tree, "written", lambda df, name, old=tree.written: rounds.append(name) or old(df, name))
    n = 10_000
    chain = tree_rows(spark, [(f"{k}", f"{k - 1}" if k else None, k) for k in range(n)])
    found = tree.tree_paths(chain, paths=False)
    assert found.where("depth = cast(id as int) and root_id = '0'").count() == n and len(rounds) < 12


def test_history_by_cells(spark):
    rng = random.Random(3)
    times = sorted(DAY + timedelta(minutes=rng.choice([rng.random() * 30, rng.random() * 9000])) for _ in range(400)) + [DAY, DAY]
    rows = [(rule, t) for rule, part in (("x", times), ("y", times[::3])) for t in part]
    want = []
    for rule in "xy":
        runs = []
        for t in sorted(t for r, t in rows if r == rule):
            if not runs or t > runs[-1][-1] + timedelta(minutes=12):
                runs.append([])
            runs[-1].append(t)
        want += [(rule, r[0], r[-1], len(r), r[-1] + timedelta(minutes=12)) for r in runs]
    fired = spark.createDataFrame(rows, "rule string, timestamp timestamp_ntz")
    for cell in (1, 60, 100_000):
        got = alerts.history(fired, 12, cell_minutes=cell).select("rule", "fired_at", "last_at", "matched", "resolved_at")
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert alerts.history(fired.limit(0), 12).count() == 0


def test_silences_of_any_length(spark):
    matches = spark.createDataFrame([(r, DAY + timedelta(hours=h)) for r in "abcde" for h in range(0, 3000, 100)], "rule string, timestamp timestamp_ntz")
    at = lambda h: DAY + timedelta(hours=h)
    rows = [("a", at(150), datetime(9999, 12, 31)), ("b", None, at(1000)), ("c", at(500), None), ("d", at(100), at(101)), ("d", at(200), at(200)), ("d", at(300), at(250)), ("d", at(1000), at(2001)), ("x", None, None)]
    got = {}
    for r in alerts.unsilenced(matches, spark.createDataFrame(rows, "rule string, start timestamp_ntz, stop timestamp_ntz")).collect():
        got.setdefault(r.rule, []).append(int((r.timestamp - DAY).total_seconds() // 3600))
    every = list(range(0, 3000, 100))
    want = {"a": [0, 100], "b": every[10:], "c": every[:5], "d": [h for h in every if h != 100 and not 1000 <= h < 2001], "e": every}
    assert {r: sorted(h) for r, h in got.items()} == want
    assert alerts.unsilenced(matches, spark.createDataFrame([], "rule string, start timestamp_ntz, stop timestamp_ntz")).count() == matches.count()


def test_pages_by_range(spark):
    rng = random.Random(4)
    times = [DAY + timedelta(days=rng.randint(0, 5), seconds=rng.choice([3, rng.randint(0, 80_000)])) for _ in range(140)] + [None] * 9
    rows = spark.createDataFrame([(f"{k:03d}", "single", "n", t, None, None, {}, None) for k, t in enumerate(times)], EVENT)
    ids = [r.id for r in query.newest_first(rows).collect()]
    for number in (1, 2, 5, 9, 10, 14, 15, 40):
        got = query.page_by_range(rows, number, 10).collect()
        assert [r.id for r in got] == ids[(number - 1) * 10 : number * 10] and all(r.has_more == (number * 10 < len(ids)) for r in got)
    assert query.page_by_range(rows.limit(0), 1).count() == 0


def test_digests_roll_up(spark):
    """A day of 24 digests over 60,000 values: ranks within a hundredth, and exact for few values."""
    rows = spark.range(60_000).select(
        F.lit("span").alias("event_type"), F.lit("n").alias("name"), (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 24).cast("int"))).alias("timestamp"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("duration_ms")
    )
    few = spark.createDataFrame([("span", "few", DAY, d) for d in (5, 1, None, 3)], "event_type string, name string, timestamp timestamp_ntz, duration_ms long")
    stored = metrics.digests(rows.unionByName(few))
    assert stored.count() == 25
    got = {r.name: r for r in metrics.digest_percentiles(metrics.rolled_up(stored)).collect()}
    assert (got["few"].n, got["few"].p50, got["few"].p99) == (3, 3, 5) and got["n"].n == 60_000
    for q, value in zip(metrics.QUANTILES, (got["n"].p50, got["n"].p95, got["n"].p99)):
        assert abs(rows.where(F.col("duration_ms") <= value).count() / 60_000 - q) < 0.01


def _exact(values, percent):
    known = sorted(v for v in values if v is not None)
    return known[max(1, -(-len(known) * percent // 100)) - 1] if known else None


def test_counts_roll_up_exactly(spark):
    """Ranks of ties, negative, missing and far durations, a bucket without a time and a name that is null, in cells of any width."""
    rng = random.Random(5)
    rows = [("span", n, DAY + timedelta(days=rng.randint(0, 1), hours=rng.randint(0, 23)), rng.choice([None, rng.randint(-50, 50), rng.randint(0, 10**12)])) for n in ("a", "b", None) for _ in range(401)]
    rows += [("span", "none", DAY, None), ("span", "a", None, 7), ("single", "a", DAY, 1)] + [("span", f"n{k}", DAY, k - j) for k in (1, 2, 20, 99, 100, 101) for j in range(k)]
    want = {}
    for kind, name, when, duration in rows:
        if kind == "span":
            want.setdefault((when and datetime(when.year, when.month, when.day), name), []).append(duration)
    want = {(*k, len(v), *[_exact(v, p) for p in (50, 95, 99)]) for k, v in want.items()}
    stored = metrics.duration_counts(spark.createDataFrame(rows, "event_type string, name string, timestamp timestamp_ntz, duration_ms long"))
    for bits in (0, 5, 20, 63):
        got = metrics.count_percentiles(metrics.rolled_counts(stored), bits).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert metrics.count_percentiles(metrics.rolled_counts(stored.limit(0))).count() == 0


def test_rolled_percentiles_of_a_full_day(spark, tmp_path):
    """More durations in a day than a sketch keeps one by one."""
    took = lambda k: 30 + k * 7919 % 40_009
    rows = [(2 * k + j, DAY + timedelta(seconds=took(k) * j), k, kind, 1.0, "{}") for k in range(12_000) for j, kind in enumerate(("click", "purchase"))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["rolled_percentiles"](spark, str(tmp_path)).collect()
    values = [took(k) * 1000 for k in range(12_000)]
    assert [tuple(r) for r in got] == [(DAY, "request", 12_000, *[_exact(values, p) for p in (50, 95, 99)])]


@pytest.mark.parametrize("text", [b"", b"\n", b"one", b"one\n", b"one\r\ntwo\n\nth\xc3\xa9e\r\n\r\nlast\r", b"x" * 50 + b"\n" + b"y\n" * 20])
def test_ranges_give_each_line_once(tmp_path, text):
    path = tmp_path / "a.log"
    path.write_bytes(text)
    want, place = [], 0
    for line in text.split(b"\n")[: -1 if text.endswith(b"\n") or not text else None]:
        want.append((place, line.removesuffix(b"\r").decode() if place + len(line) < len(text) else line.decode().removesuffix("\r")))
        place += len(line) + 1
    for size in (1, 2, 3, 7, 1000):
        for address in (str(path), f"file://{path}"):
            got = [(r["byte_offset"], r["line"]) for k in range(0, len(text), size) for b in range_lines(address, k, min(len(text), k + size)) for r in b.to_pylist()]
            assert got == want


def test_listings(tmp_path):
    for name in ("a/x.log", "a/y.txt", "b/x.log", "x.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12")
    short = lambda found: [p.removeprefix("file://").removeprefix(f"{tmp_path}/") for p in found]
    for head in (f"{tmp_path}", f"file://{tmp_path}"):
        assert short(listing(f"{head}/*/*.log")) == ["a/x.log", "b/x.log"] and short(listing(f"{head}/*.log")) == ["x.log"]
        assert listing(f"{head}/a/y.txt") == {f"{head}/a/y.txt": 2} and listing(f"{head}/none.log") == {} and listing(f"{head}/none/*.log") == {}


def test_tail_by_bounded_batches(tmp_path):
    (tmp_path / "a.log").write_text("0123456789\n" * 10)
    (tmp_path / "b.log").write_text("x" * 100 + "\nshort\n")
    reader = TailReader(f"file://{tmp_path}/*.log", True, 60)
    start, got, steps = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != start:
        rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        assert sum(len(r["line"]) for r in rows if r["file_path"].endswith("a.log")) <= 60
        got, start, steps = got + rows, end, steps + 1
        if steps == 1:
            (tmp_path / "c.log").write_text("new\n")
        if steps == 2:
            (tmp_path / "b.log").unlink()
    assert sorted(r["line"] for r in got if not r["file_path"].endswith("b.log")) == sorted(["0123456789"] * 10 + ["new"]) and steps > 2
    assert [r["line"] for r in got if r["file_path"].endswith("b.log")][:1] == ["x" * 100]


@pytest.mark.parametrize(
    "fmt, texts",
    [("%d/%b/%Y:%H:%M:%S %z", {"09/Aug/2032:04:05:06 -0700": "2032-08-09 04:05:06", "09/Aug/2032:04:05:06": None, "31/Jun/2032:04:05:06 +0000": None}), ("%s", {"86399": "1970-01-01 23:59:59", "1e3": None}),
     ("%y%m%d %H%M%S", {"690809 040506": "2069-08-09 04:05:06", "700809 040506": "1970-08-09 04:05:06", "701309 040506": None}), ("%Y-%j %T%.f", {"2032-366 01:02:03.25": "2032-12-31 01:02:03.25", "2033-366 01:02:03": None}),
     ("%A %e %B %Y %I:%M %p", {"Monday  9 August 2032 12:07 AM": "2032-08-09 00:07:00", "tue 10 aug 2032 01:07 pm": "2032-08-10 13:07:00", "Monday 10 August 2032 01:07 PM": None, "Tuesday 10 August 2032 13:07 PM": None})],
)
def test_rare_formats(spark, fmt, texts):
    got = parse_times(pd.Series([*texts, None]), format_pattern(fmt))
    assert [None if pd.isna(t) else t for t in got] == [*(t and pd.Timestamp(t) for t in texts.values()), None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(timestamp(F.col("t"), spark_time_format(fmt)).alias("at")).collect()
    assert [r.at for r in rows] == [t and pd.Timestamp(t).to_pydatetime() for t in texts.values()]


def test_formats_without_a_time():
    assert spark_time_format("%y-%m-%d") is None and spark_time_format("%a %H:%M") is None
    with pytest.raises(ConfigError, match="%U"):
        spark_time_format("%Y %U %H:%M")
