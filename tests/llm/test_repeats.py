"""Substring dedup: what it writes in between, and copies whose rows share ids."""

import random
import re

import pytest

from emberlog.llm import repeats

DOCS = "doc_id long, text string"


@pytest.fixture
def seen(monkeypatch):
    """Names and plans of the tables that are written in between."""
    found, written = {}, repeats.written

    def noted(df, name):
        assert name not in found
        found[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(repeats, "written", noted)
    return found


def rows():
    """A text with very many copies, parts of it, texts of their own, ids that several rows share, null ids and texts."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    common, other = [word() for _ in range(40)], [word() for _ in range(30)]
    found = [(k, " ".join(common)) for k in range(5, 65)]
    found += [(5, " ".join(other)), (6, " ".join(common)), (7, None), (70, " ".join(other)), (71, " ".join(other)), (71, " ".join(other))]
    found += [(k, " ".join([word(), *common[k - 80 : k - 60], word(), *other[:15]])) for k in range(80, 100)]
    found += [(k, " ".join(word() for _ in range(30))) for k in range(100, 120)]
    return found + [(None, " ".join(common)), (None, None), (120, ""), (121, "one two")]


def brute(table):
    first, out = {}, []
    for i, text in table:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    for i, text in table:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        starts = [k for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i] if i is not None else []
        gone = {k + j for k in starts for j in range(13)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("limit", [5_000, 1])
def test_copies_and_shared_ids(spark, seen, limit, monkeypatch):
    """Each file that is written starts processes of its executor for the file's mode: no table more than needs to be."""
    monkeypatch.setattr(repeats, "ANCHOR_TEXTS", limit)
    found = repeats.substring_dedup(spark.createDataFrame(rows(), DOCS))
    assert sorted((-1 if r.id is None else r.id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == brute(rows())
    assert set(seen) == {f"repeat-{x}" for x in ("places", "copies", "stretches", "heads", "unlike", "texts", "firsts", "spans")}


def test_copies_of_one_text_are_dealt_by_id(spark, seen):
    repeats.substring_dedup(spark.createDataFrame(rows(), DOCS))
    joins = re.findall(r"Join \[(.*?)\]", seen["repeat-copies"])
    assert joins and all(re.search(r"\bid#", x) for x in joins)
