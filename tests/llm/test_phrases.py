"""Collocations against plain counting."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import phrases

DOCS = "text string, lang string"


def brute(rows, support, top, longest=5):
    out = []
    pieces = {}
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            pieces.setdefault(lang or "und", []).append(re.findall("[^ \t]+", piece))
    for lang, every in pieces.items():
        n, count = sum(map(len, every)), {}
        for words in every:
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    g = tuple(words[i : i + k])
                    count[g] = count.get(g, 0) + 1
        count = {g: a for g, a in count.items() if a >= support}
        found = []
        for g, a in count.items():
            inside = any(len(q) > len(g) and b >= a and any(q[i : i + len(g)] == g for i in range(len(q))) for q, b in count.items())
            if len(g) > 1 and not inside:
                score, _, left, right = min((1000 * a * n // (count[g[:k]] * count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def result(docs, **how):
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[c] for c in columns) for r in phrases.collocations(docs, **how).collect())


@pytest.mark.parametrize("support, top", [(3, 10_000), (8, 7)])
def test_phrases(spark, monkeypatch, support, top):
    """Small shards and runs, so that phrases cross them; repeats, overlaps, marks that part pieces, other alphabets."""
    for name, value in (("SHARD_WORDS", 300), ("AT_ONCE", 40)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "buckets_for", lambda entries: 5)
    rng = random.Random(6)
    words = ["New", "york", "été", "ÉTÉ", "city", "a", "b c", "x-y", "日本", "the"]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["new york city", "a a a a", *words]) + rng.choice([" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\x0b", " ?! "])
        rows.append((text, ["en", "fr", None, "und"][k % 4]))
    rows += [(None, "en"), ("", "de"), (" .. ", "de"), ("one", "es"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("word", "phrase", "n", "shard", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    want = brute(rows, support, top)
    assert len(want) > 20 and result(docs, support=support, top=top) == want


def test_no_phrases(spark):
    assert result(spark.createDataFrame([], DOCS)) == [] and result(spark.createDataFrame([("a b c", "en"), (None, None)], DOCS)) == []


def test_bitmaps_extend_by_shift_and_and():
    rng = np.random.default_rng(8)
    line = rng.integers(0, 6, 3000)
    a, b, n = phrases.pairs_in(line, 5)
    want = {}
    for x, y in zip(line, line[1:]):
        if x and y:
            want[x, y] = want.get((x, y), 0) + 1
    assert {(x, y): k for x, y, k in zip(a.tolist(), b.tolist(), n.tolist())} == want
    follows = np.sort(a * 6 + b)
    got, want = {}, {}
    for rows, count in phrases.longer_phrases(line, 5, follows):
        for row, k in zip(rows.tolist(), count.tolist()):
            got[tuple(row)] = got.get(tuple(row), 0) + k
    for size in (3, 4, 5):
        for i in range(len(line) - size + 1):
            if (g := line[i : i + size]).all():
                g = (*g.tolist(), *[0] * (5 - size))
                want[g] = want.get(g, 0) + 1
    assert got == want


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits."""
    a, n, l, r = 10**15 + 7, 10**16 + 3, 10**15 + 9, 10**15 + 11  # noqa: E741
    sql = "(cast(1000 as decimal(4,0)) * cast({} as decimal(17,0)) * cast({} as decimal(17,0))) div (cast({} as decimal(18,0)) * cast({} as decimal(18,0)))"
    assert spark.range(1).select(F.expr(sql.format(a, n, l, r))).first()[0] == 1000 * a * n // (l * r)
