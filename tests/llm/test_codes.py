"""Vector codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label). Code, error of each kept row and the final books."""
    good = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    order = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, k) for _, v, _ in order[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, k: min((far(cut(v, k), c), j) for j, c in enumerate(books[k]))
    for _ in range(rounds):
        new = []
        for k in range(parts):
            owned = {}
            for _, v, _ in good:
                owned.setdefault(near(v, k)[1], []).append(cut(v, k))
            new.append([[sum(c) // len(owned[j]) for c in zip(*owned[j])] if j in owned else b for j, b in enumerate(books[k])])
        books = new
    found = [(i, "".join(f"{near(v, k)[1]:02x}" for k in range(parts)), sum(near(v, k)[0] for k in range(parts)), label) for i, v, label in good]
    return found, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def result(spark, rows, **how):
    coded, books = codes.vector_codes(spark.createDataFrame(rows, VECTORS), **how)
    out = codes.with_label_errors(coded).select("id", F.lower(F.hex("code")).alias("code"), "error", "label", "label_error")
    return sorted(map(tuple, out.collect()), key=str), codes.digest(books)


@pytest.mark.parametrize("entries", [256, 6])
def test_codes(spark, entries):
    rng = random.Random(2)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(120)]
    rows += [(200 + i, list(rows[i][1]), 3) for i in range(30)]  # repeated vectors, so that entries tie
    rows += [(7, [0.5] * 8, 2), (None, [0.25] * 8, None), (None, None, 1), (301, [None] * 8, 1), (302, [float("nan")] * 8, 1), (303, [math.inf] + [0.0] * 7, 1), (304, [], 1), (305, [1.0], 1), (306, [0.1] * 12, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    kept = [r for r in rows if r[0] not in (304, 305, 306)]
    want, books = brute(kept, entries=entries)
    got, found = result(spark, rows, entries=entries)
    total = {}
    for _, _, e, label in want:
        total[label] = total.get(label, 0) + e
    assert found == books and got == sorted([(i, c, e, label, total[label]) for i, c, e, label in want], key=str)


def test_wide_components_are_exact(spark):
    """Beyond what floats hold: Python integers; an error of over 64 bits is null."""
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.uniform(-3e5, 3e5))) for _ in range(8)], 0) for i in range(40)]
    want, books = brute(rows, entries=5)
    got, found = result(spark, rows, entries=5)
    assert found == books and [(i, c, e) for i, c, e, _, _ in got] == sorted([(i, c, e) for i, c, e, _ in want], key=str)
    huge = [(0, [0.0] * 4, 0), (1, [4e10, 0.0, 0.0, 0.0], 0), (2, [-4e10, 0.0, 0.0, 0.0], 1), (3, [1e30, 0.0, 0.0, 0.0], 1)]
    got, _ = result(spark, huge, entries=1)
    assert [r[0] for r in got] == [0, 1, 2] and got[1][2] is None and got[1][4] is None


def test_empty_and_clashing(spark):
    assert result(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    rows = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 5)], VECTORS)
    for name in ("id", "v", "x", "code", "part", "a.b", "key", "n", "total"):
        rows = rows.withColumn(name, F.lit(1))
    out = codes.with_label_errors(codes.vector_codes(rows)[0]).collect()
    assert [(r.id, r.error, r.label_error, r.code.hex()) for r in out] == [(1, 0, 0, "00000000")]


def test_exponion_scans_what_is_needed():
    """The nearest entry and the lowest of ties, from any start."""
    rng = np.random.default_rng(3)
    for scale in (3, 50, 1 << 40):
        book = codes.Book((rng.integers(-scale, scale, (30, 2))).tolist())
        x, start = rng.integers(-scale, scale, (400, 2)), rng.integers(0, 30, 400)
        found, error = book.nearest(x, start)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(book.entries)) for v in x]
        assert [(int(e), int(j)) for e, j in zip(error, found)] == want
