import time
from datetime import datetime

import pytest

from emberlog.functions.config import load_config
from emberlog.jobs.registry import CONFIG
from emberlog.functions.patterns import ConfigError
from emberlog.operators import filters, query, tree
from emberlog.operators.chain import EVENT
from emberlog.operators.filters import Filter
from emberlog.sources import store
from emberlog.sources.formats import logfmt_events
from emberlog.sources.lines import read_lines
from emberlog.sources.tail import TailReader, TailSource
from emberlog.streaming.ingest import start_ingest


@pytest.fixture(scope="module")
def events(spark):
    d = lambda s: datetime(2025, 1, 1, 0, 0, s)
    rows = [
        ("a", "span", "job", d(0), 5000, None, {"status": "ok", "n": "1"}, "x\ny"), ("b", "single", "note", d(1), None, "a", {"n": "2"}, "b%"), ("c", "span", "Job2", d(2), 100, "a", {"status": "bad"}, None),
        ("d", "single", "note", d(2), None, "gone", {}, "d"), ("e", "single", "note", d(3), None, "f", {}, "e"), ("f", "single", "note", d(3), None, "e", {}, "f"), ("g", "single", "leaf", d(4), None, "c", {}, "g"),
    ]
    return spark.createDataFrame(rows, EVENT)


@pytest.mark.parametrize(
    "f, ids",
    [(lambda: filters.timestamp("eq", "2025-01-01 00:00:02"), "cd"), (lambda: filters.timestamp("lt", "2025-01-01 00:00:01"), "a"), (lambda: filters.timestamp("gte", "2025-01-01 00:00:03"), "efg"),
     (lambda: filters.timestamp("in", ["2025-01-01 00:00:00", "2025-01-01 00:00:01"]), "ab"), (lambda: filters.timestamp("like", "%00:04"), "g"), (lambda: filters.event_id("in", ["a", "z"]), "a"),
     (lambda: filters.event_id("in", []), ""), (lambda: filters.parent_id("eq", "a"), "bc"), (lambda: filters.duration("gt", 100), "a"), (lambda: filters.duration("lte", 100), "c"), (lambda: filters.duration("in", [100, 5000]), "ac"),
     (lambda: filters.name("like", "JOB%"), "ac"), (lambda: filters.data("status", "eq", "ok"), "a"), (lambda: filters.data("status", "like", "B%"), "c"), (lambda: filters.data("none", "eq", "x"), ""),
     (lambda: filters.or_([filters.name("eq", "leaf"), filters.and_([filters.name("eq", "note"), filters.parent_id("eq", "a")])]), "bg")],
)
def test_filters(events, f, ids):
    assert "".join(sorted(r.id for r in Filter(f()).apply(events).collect())) == ids


def test_filter_errors(events):
    for bad in (lambda: filters.duration("like", "1"), lambda: filters.data("x", "gt", "1"), lambda: filters.and_([]), lambda: filters.name("ne", "x"), lambda: Filter(filters.or_([filters.name("eq", "a")])).with_name("eq", "b")):
        with pytest.raises(ValueError):
            bad()
    assert Filter().apply(events).count() == 7 and Filter().with_name("eq", "note").with_parent_id("eq", "a").apply(events).count() == 1
    assert events.where(filters.kind_filter("other") & filters.name_contains("  ")).count() == 7


def test_pages_and_detail(events):
    first = query.page(events, 1, 4).collect()
    assert [r.id for r in first] == ["g", "e", "f", "c"] and first[0].has_more
    second = query.page(events, 2, 4).collect()
    assert [r.id for r in second] == ["d", "b", "a"] and not second[0].has_more
    assert [r.id for r in query.page_after(events, first[-1].timestamp, first[-1].id, 4).collect()] == ["d", "b", "a"]
    shown = query.detail(events, "a").collect()
    assert [(r.key, r.value) for r in shown] == [("n", "1"), ("status", "ok")] and shown[0].raw == "x - y"
    assert query.detail(events, "zz").count() == 0


def test_tree(events):
    got = {r.id: (r.depth, list(r.path)) for r in tree.tree_paths(events).collect()}
    assert got == {"a": (0, ["job"]), "b": (1, ["job", "note"]), "c": (1, ["job", "Job2"]), "g": (2, ["job", "Job2", "leaf"])}  # no orphan, no cycle
    assert {r.stack: r.self_ms for r in tree.folded(events).collect()} == {"job": 4900, "job;Job2": 100}
    assert {r.id: r.start_offset_ms for r in tree.waterfall(events, "c").collect()} == {"c": 0, "g": 2000}


def test_store(spark, events, tmp_path):
    path = str(tmp_path / "events")
    for _ in range(2):
        store.append_events(events, path)
    assert store.load_events(spark, path).count() == 7 and store.load_events(spark, path, Filter().with_name("eq", "note")).count() == 4
    back = {r.id: r for r in store.decode_rows(store.encode_rows(events)).collect()}
    assert back["a"].data == {"status": "ok", "n": "1"} and (back["a"].raw_start, back["a"].raw_end) == ("x", "y") and back["b"].raw_start is None
    with pytest.raises(Exception, match="unknown event type"):
        store.decode_rows(store.encode_rows(events.replace("single", "odd", ["event_type"]))).collect()
    kept = store.retained(events, {"note": 1}, datetime(2025, 1, 3)).collect()
    assert sorted(r.id for r in kept) == ["a", "c", "g"]


def test_stores_by_configuration(spark, events, tmp_path):
    sql = {"type": "jdbc", "url": f"jdbc:derby:memory:{tmp_path.name};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    for config in ({"type": "parquet", "path": str(tmp_path / "events")}, sql):
        kept = store.open_store(config)
        kept.append(events.limit(0))
        for some in (events.where("id < 'd'"), events, events):  # rows that are stored already add nothing
            kept.append(some)
        rows = lambda df: sorted((r.id, r.timestamp, r.duration_ms, r.parent_id, sorted(r.data.items()), r.raw_line) for r in df.collect())
        assert rows(kept.load(spark)) == rows(events)
        assert rows(kept.load(spark, Filter().with_data("status", "eq", "ok").with_timestamp("lt", "2025-01-01 00:00:01"))) == rows(events.where("id = 'a'"))
    for bad in ({}, {"type": "parquet"}, {"type": "jdbc"}, {"type": "other", "path": "x"}):
        with pytest.raises(ConfigError, match="not a store"):
            store.open_store(bad)


def test_resume(spark):
    files = spark.createDataFrame([("a", 100), ("b", 50), ("c", 75), ("d", 200)], "file_path string, size long")
    cursors = store.latest_cursors(spark.createDataFrame([("a", 10, 1), ("a", 30, 2), ("b", 200, 1), ("d", 20, 1)], "file_path string, cursor long, seq long"))
    pending = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "file_path string")
    assert {r.file_path: r.offset for r in store.resume(files, cursors, pending).collect()} == {"a": 30, "b": 50, "c": 75, "d": 200}


def test_offsets_of_real_files(spark, tmp_path):
    for name, text in (("a.log", "één\r\n\nzwei\n"), ("b.log", "x" * 100 + "\nlast")):
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((r.file_path.rsplit("/", 1)[-1], r.byte_offset, r.line) for r in read_lines(spark, str(tmp_path / "*.log")).collect())
    assert got == [("a.log", 0, "één"), ("a.log", 7, ""), ("a.log", 8, "zwei"), ("b.log", 0, "x" * 100), ("b.log", 101, "last")]


def test_logfmt(spark):
    line = 'timestamp="2025-01-01 00:00:00" a=1 b="x \\"y\\" z" a=2'
    got = logfmt_events(spark.createDataFrame([("f", 0, line)], "file_path string, byte_offset long, line string")).first()
    assert got.data == {"timestamp": "2025-01-01 00:00:00", "a": "2", "b": 'x "y" z'}


def test_tail_offsets(tmp_path):
    path = tmp_path / "t.log"
    path.write_text("one\ntwo\npart")
    reader = TailReader(str(tmp_path / "*.log"), True)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert [(at, line) for p in reader.partitions(start, end) for b in reader.read(p) for _, at, line in zip(*b.to_pydict().values())] == [(0, "one"), (4, "two")]
    path.write_text("new\n")
    after = reader.latestOffset()
    assert after[str(path)] == 0 and not reader.partitions(end, after)
    assert [line for p in reader.partitions(after, reader.latestOffset()) for b in reader.read(p) for line in b.column('line').to_pylist()] == ["new"]


def test_tail_stream_with_restart(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, root = tmp_path / "app.log", str(tmp_path / "out")
    stream = lambda: spark.readStream.format("logtail").option("path", str(log)).option("starting_position", "earliest").load()
    text = ["2024-01-01 00:00:00 U000001 START op=a", "2024-01-01 00:00:03 U000001 NOTE k=4", "2024-01-01 00:00:05 U000001 END status=200"]
    log.write_text(text[0] + "\n")
    for more in (text[1:], []):
        q = start_ingest(stream(), load_config(CONFIG), root, processingTime="1 second")
        deadline = time.time() + 40
        while time.time() < deadline and not q.recentProgress or q.status["isDataAvailable"]:
            time.sleep(0.5)
        time.sleep(2)
        q.stop()
        with log.open("a") as f:
            f.write("".join(x + "\n" for x in more))
    rows = spark.read.parquet(f"{root}/events").collect()
    assert sorted((r.name, r.duration_ms) for r in rows if r.name == "request") == [("request", 5000)]
    assert [r.parent_id for r in rows if r.name == "note"] == [r.id for r in rows if r.name == "request"]


def test_tail_reads_a_file_cut_while_the_stream_was_down(tmp_path):
    path = tmp_path / "t.log"
    path.write_text("a line that was read before the stop\n")
    reader = TailReader(str(tmp_path / "*.log"), True)
    reader.initialOffset()
    committed = reader.latestOffset()
    path.write_text("new one\nnew two\n")
    again = TailReader(str(tmp_path / "*.log"), True)
    found = again.latestOffset()
    assert [(at, line) for p in again.partitions(committed, found) for b in again.read(p) for _, at, line in zip(*b.to_pydict().values())] == [(0, "new one"), (8, "new two")]


def test_spread_join(spark, monkeypatch):
    from emberlog.operators import skew

    monkeypatch.setattr(skew, "LEAST_ROWS", 5)
    left = spark.createDataFrame([(k, "hot" if k < 50 else "cold" if k < 53 else None if k < 55 else "none") for k in range(60)], "v long, key string")
    right = spark.createDataFrame([("hot", 50, 1), ("cold", 3, 2), ("unmet", 1, 3)], "key string, n long, w long")
    got = {r.v: r.w for r in skew.spread_join(left, right, ["key"], "n", "left").collect()}
    assert got == {k: 1 if k < 50 else 2 if k < 53 else None for k in range(60)}
    assert skew.spread_join(left, right, ["key"], "n").count() == 53


def test_tree_from_an_event_of_a_cycle(events):
    assert {r.id: r.depth for r in tree.tree_paths(events, "e").collect()} == {"e": 0, "f": 1}
