import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions.config import load_config, parsers_of, path_pattern
from emberlog.functions.fields import captures, short_date, timestamp
from emberlog.functions.patterns import ConfigError, compile_pattern, expand, spark_time_format
from emberlog.operators.chain import parse_logs, pattern_coverage

ISO = "%Y-%m-%d %H:%M:%S"
TS = r"(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
SPAN = {"name": "s", "type": "span", "glob": "*", "start_pattern": TS + r" (?P<ref>[a-z]{3}) BEGUN", "end_pattern": TS + r" (?P<ref>[a-z]{3}) DONE", "reference_fields": ["ref"]}


def config(*parsers, **more):
    return load_config({"defaults": {"timestamp_format": ISO}, "parsers": list(parsers), **more})


@pytest.mark.parametrize(
    "text, fmt, ok",
    [("2031-11-05 17:04:09", ISO, True), ("05.11.2031 at 17h04m09", "%d.%m.%Y at %Hh%Mm%S", True), (" ", ISO, False), ("yesterday", ISO, False), ("2031-11-05 17:04", ISO, False),
     ("2031-02-30 17:04:09", ISO, False), ("2031-11-05 17:04:09Z", ISO, False), ("2031-11-05 17:04:09", "%Y/%m/%d %H:%M:%S", False), ("05.11.2031", "%d.%m.%Y", False), ("20311105T170409", "%Y%m%dT%H%M%S", True)],
)
def test_timestamps(spark, text, fmt, ok):
    got = spark.createDataFrame([(text,)], "t string").select(timestamp(F.col("t"), spark_time_format(fmt)).cast("string")).first()[0]
    assert got == ("2031-11-05 17:04:09" if ok else None)


def test_short_date(spark):
    rows = spark.createDataFrame([("2025-01-02",), ("2025-01-02 03:04:05",), ("x",)], "t string").select(short_date(F.col("t")).cast("string")).collect()
    assert [r[0] for r in rows] == ["2025-01-02 00:00:00", "2025-01-02 03:04:05", None]


@pytest.mark.parametrize(
    "pattern, line, data",
    [(r"job (?P<job>[A-Z]+)-(?P<step>\d+)", "late job QX-17 done", {"job": "QX", "step": "17"}), (r"(?P<host>\w+)(?P<port>:\d+)?;", "db1;", {"host": "db1"}),
     (r"(?P<host>\w+)(?P<port>:\d+)?;", "db1:80;", {"host": "db1", "port": ":80"}), (r"(?P<level>LOW|HIGH) (\w+)", "is HIGH tide", {"level": "HIGH"}), (r"q=(?P<query>[a-z]*)&", "?q=&x", {"query": ""}),
     (r"(?P<a>x*)y|(?P<b>z)", "z", {"b": "z"}), (r"[(](?P<inner>[^)]*)[)]", "f()", {"inner": ""}), (r"(?P<w>\p{Lu}\pL+) (?P<g>\p{Greek}+)?", "x Éva λόγος", {"w": "Éva", "g": "λόγος"}), (r"(?P<w>\p{Lu}\P{N}) (?P<g>\p{Greek}*|x)", "É! 1", {"w": "É!", "g": ""}),
     (r"tide", "is HIGH tide", {})],
)
def test_captures(spark, pattern, line, data):
    got = spark.createDataFrame([(line,)], "line string").select(captures(F.col("line"), compile_pattern(pattern, {}))).first()[0]
    assert got == data


def test_expand():
    assert expand("${a} x", {"a": "b c"}) == r"(?:b c)\s+x"
    assert expand(r"\${a}", {}) == r"\${a}"
    for bad in ("${a", "${missing}"):
        with pytest.raises(ConfigError):
            expand(bad, {})


@pytest.mark.parametrize(
    "change, words",
    [({"type": None}, "missing type"), ({"name": None}, "missing name"), ({"glob": None}, "missing glob"), ({"type": "other"}, "unknown type"), ({"end_pattern": SPAN["start_pattern"]}, "different"),
     ({"reference_fields": []}, "reference_fields"), ({"start_pattern": TS + " BEGUN"}, "'ref'"), ({"start_pattern": "(?P<ref>x) BEGUN"}, "'timestamp'"),
     ({"nested": [{"name": "n", "type": "span", "start_pattern": TS, "end_pattern": TS}]}, "reference_fields"), ({"nested": [{**SPAN, "name": "n"}]}, "duplicates"), ({"start_pattern": "(?=x)"}, "look-around")],
)
def test_config_errors(change, words):
    raw = {k: v for k, v in {**SPAN, **change}.items() if v is not None}
    with pytest.raises(ConfigError, match=words):
        config(raw)


def test_globs_keep_order():
    found = config({**SPAN, "glob": "/var/*.log"}, {**SPAN, "name": "t", "glob": "*.log"})
    assert [p.name for p in parsers_of("/var/a.log", found)] == ["s", "t"] and [p.name for p in parsers_of("/b/a.log", found)] == ["t"]


@pytest.mark.parametrize(
    "glob, path, ok",
    [("/x/a*.log", "/x/a1.log", True), ("/x/a*.log", "/x/b1.log", False), ("/x/a*.log", "/x/a/1.log", False), ("/x/**/*.log", "file:///x/y/z/1.log", True), ("*.log", "s3a://b/x/1.log", True), ("a?[0-2].log", "/y/ab1.log", True), ("a?[!0-2].log", "/y/ab1.log", False)],
)
def test_paths_of_globs(glob, path, ok):
    assert bool(re.search(path_pattern(glob), path)) == ok


def test_lines_go_to_the_parsers_of_their_file(spark):
    one = {"name": "a", "type": "single", "glob": "/x/a*.log", "pattern": TS + ".*"}
    lines = spark.createDataFrame([("/x/a1.log", 0, f"{at(1)} v"), ("/x/b1.log", 0, f"{at(1)} v"), ("/x/c1.log", 0, f"{at(1)} v")], "file_path string, byte_offset long, line string")
    found = parse_logs(lines, config(one, {**one, "name": "b", "glob": "/x/[ab]*.log"})).events.collect()
    assert sorted((r.file_path, r.name) for r in found) == [("/x/a1.log", "a"), ("/x/b1.log", "b")]


def at(n):
    return f"2026-01-01 {n // 3600:02d}:{n // 60 % 60:02d}:{n % 60:02d}"


def run(spark, parsers, lines, pending=None, **kw):
    df = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file_path string, byte_offset long, line string")
    return parse_logs(df, parsers, pending, **kw)


@pytest.mark.parametrize(
    "lines, durations, open_",
    [(["0 a BEGUN", "5 a DONE"], [5000], 0), (["0 a BEGUN", "2 b BEGUN", "5 a DONE", "8 b DONE"], [5000, 6000], 0), (["0 a BEGUN"], [], 1), (["3 a BEGUN", "3 a DONE"], [0], 0),
     (["0 a BEGUN", "2 a BEGUN", "5 a DONE"], [5000], 0), (["5 a DONE"], [], 0), (["9 a BEGUN", "4 a DONE"], [-5000], 0), (["0 a BEGUN", "x a DONE", "5 a DONE"], [], 0)],
)
def test_spans(spark, lines, durations, open_):
    text = []
    for x in lines:
        n, ref, mark = x.split()
        text.append(f"{'2026-02-30 01:02:03' if n == 'x' else at(int(n))} {ref * 3} {mark}")
    parsed = run(spark, config(SPAN), text)
    assert sorted(r.duration_ms for r in parsed.events.collect()) == durations and parsed.pending.count() == open_


def test_start_wins_and_ids_are_stable(spark):
    lines = [f"{at(1)} aaa BEGUN", f"{at(2)} aaa DONE"]
    one, two = (run(spark, config(SPAN), lines).events.first() for _ in range(2))
    assert one.data["timestamp"] == at(1) and one.id == two.id and one.raw_line == "\n".join(lines)


NESTED = {**SPAN, "nested": [
    {"name": "note", "type": "single", "pattern": TS + r" (?P<ref>[a-z]{3}) NOTE"},
    {"name": "sub", "type": "span", "reference_fields": ["job"], "start_pattern": TS + r" (?P<ref>[a-z]{3}) SUB (?P<job>\d) ON", "end_pattern": TS + r" (?P<ref>[a-z]{3}) SUB (?P<job>\d) OFF",
     "nested": [{"name": "leaf", "type": "single", "pattern": TS + r" (?P<ref>[a-z]{3}) LEAF (?P<job>\d)"}]},
]}


def machine(lines):
    """One line after the other, as the words of the operators say: (line number, name, parent's line)."""
    outer, inner, out = {}, {}, []
    for k, (mark, ref, job, good) in enumerate(lines):
        if mark == "BEGUN":
            if good and ref not in outer:
                outer[ref] = k
        elif mark == "DONE":
            start = outer.pop(ref, None)
            if start is not None and good:
                out.append((start, "s", None))
        elif mark == "NOTE" and good:
            if ref in outer:
                out.append((k, "note", outer[ref]))
        elif mark == "ON":
            if good and (ref, job) not in inner:
                inner[ref, job] = k
        elif mark == "OFF":
            start = inner.pop((ref, job), None)
            if start is not None and good and ref in outer:
                out.append((start, "sub", outer[ref]))
        elif mark == "LEAF" and good and (ref, job) in inner and ref in outer:
            out.append((k, "leaf", outer[ref]))
    return sorted(out, key=str)


def test_random_sequences_with_nested_spans(spark):
    rng = random.Random(5)
    lines = [(rng.choice(["BEGUN", "DONE", "NOTE", "ON", "OFF", "LEAF"]), rng.choice("ab"), rng.choice("12"), rng.random() > 0.1) for _ in range(800)]
    text = []
    for k, (mark, ref, job, good) in enumerate(lines):
        tail = f"SUB {job} {mark}" if mark in ("ON", "OFF") else f"LEAF {job}" if mark == "LEAF" else mark
        text.append(f"{at(k) if good else '2026-02-30 01:02:03'} {ref * 3} {tail}")
    parsed = run(spark, config(NESTED), text)
    rows = parsed.events.collect()
    line_of = {r.id: lines_at(r) for r in rows}
    got = sorted([(line_of[r.id], r.name, line_of.get(r.parent_id, r.parent_id)) for r in rows], key=str)
    want = machine(lines)
    # A parent that never closes has no event of its own; compare whether there is one, and its line where there is.
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    for (_, _, p), (_, _, q) in zip(got, want):
        assert (p is None) == (q is None) and (not isinstance(p, int) or p == q)


def lines_at(row):
    h, m, s = row.data["timestamp"][11:].split(":")
    return int(h) * 3600 + int(m) * 60 + int(s)


def test_chain_claims_and_pending(spark):
    catch = {"name": "any", "type": "single", "glob": "*", "pattern": TS + ".*"}
    lines = [f"{at(0)} aaa BEGUN", f"{at(1)} aaa BEGUN", f"{at(2)} bbb DONE", f"{at(3)} aaa DONE", "no time"]
    parsed = run(spark, config(SPAN, catch), lines)
    got = sorted((r.name, r.timestamp.second) for r in parsed.events.collect())
    assert got == [("any", 1), ("any", 2), ("s", 0)]  # what the span parser doesn't claim goes on
    cover = {r.parser: (r.matched, r.claimed, r.shadowed) for r in pattern_coverage(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file_path string, byte_offset long, line string"), config(SPAN, catch), parsed).collect()}
    assert cover == {"s": (4, 2, 2), "any": (4, 2, 2)}
    first = run(spark, config(SPAN), lines[:1])
    later = run(spark, config(SPAN), [f"{at(9)} aaa DONE"], first.pending)
    assert [r.duration_ms for r in later.events.collect()] == [9000] and later.pending.count() == 0


def test_include_raw(spark):
    got = run(spark, config({**SPAN, "include_raw": False}), [f"{at(0)} aaa BEGUN", f"{at(1)} aaa DONE"]).events.first()
    assert got.raw_line is None
