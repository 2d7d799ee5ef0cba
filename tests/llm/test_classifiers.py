"""The quality discriminant and its statistics against plain formulas."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import quality


def texts(n, seed):
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)] + ["12", "#!", "A.", "Big,"]
    return ["".join(rng.choice(v) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def plain(text):
    """The statistics as their names say, by plain Python."""
    raw, words = text.encode(), re.findall("[^\x20\x09-\x0d]+", text)
    share = lambda x, of: math.log((x / max(of, 1) + 0.002) / (1 - min(x / max(of, 1), 1) + 0.002))
    sizes, pairs, lines = [len(w.encode()) for w in words], list(zip(words, words[1:])), [x for x in text.split("\n") if x]
    mean = sum(sizes) / max(len(sizes), 1)
    spread = math.sqrt(max(sum(s * s for s in sizes) / max(len(sizes), 1) - mean * mean, 0))
    letters = lambda w: any(c.isalnum() or ord(c) > 127 for c in w)
    of = lambda test: sum(map(test, text))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(mean), math.log1p(spread), share(len(set(words)), len(words)), share(max(map(words.count, words), default=0), len(words)),
        share(len(set(pairs)), max(len(words) - 1, 1)), share(sum(a == b for a, b in pairs), len(words)), share(of(lambda c: ord(c) < 128 and not c.isalnum() and c not in ".,;:!? \t\n\r\x0b\x0c"), len(raw)),
        share(of(str.isdigit), len(raw)), share(of(lambda c: "A" <= c <= "Z"), len(words)), share(of(lambda c: c in ".,;:!?"), len(words)), share(sum(not letters(w) for w in words), len(words)),
        math.log1p(len(words) / max(len(lines), 1)), share(len(set(lines)), len(lines)), share(sum(b >= 128 for b in raw), len(raw)),
    ]


def test_statistics(spark):
    rows = [*texts(40, 3), "", "one", "one one", "\n\n", " é "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*rows, None])], "doc_id long, text string")
    got = {r.id: r.x for r in quality.document_statistics(docs).collect()}
    for k, t in enumerate([*rows, ""]):
        assert got[k] == pytest.approx(plain(t), abs=1e-9)


def test_discriminant(spark):
    """Means, shrunk covariances and log densities with other linear algebra; labels that disagree count as good."""
    rng = np.random.default_rng(4)
    d, n, shrink = len(quality.STATISTICS), 400, 0.2
    label = rng.integers(0, 2, n)
    x = rng.normal(0, 1, (n, d)) * (1 + label[:, None]) + label[:, None] * 0.5 + rng.normal(0, 1, (n, 1))
    stats = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "id long, x array<double>")
    marks = [(k, int(c)) for k, c in enumerate(label)] + [(0, 0), (0, 1), (None, 1), (5, None), (6, 7), (9999, 1)]
    model = quality.fit(stats, spark.createDataFrame(marks, "doc_id long, quality int"), shrink=shrink)
    label[0] = 1
    used = np.array([zlib.crc32(str(k).encode()) % 3 != 1 for k in range(n)])
    parts = [x[used & (label == c)] for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(c * len(p) for c, p in zip(covs, parts)) / used.sum()
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + 1e-4 * np.eye(d)
    density = []
    for c, p in zip(covs, parts):
        s = (1 - shrink) * c + shrink * pooled
        away = x - p.mean(0)
        density.append(np.log(len(p) / used.sum()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,ij->i", away @ np.linalg.inv(s), away))
    got = {r.id: r.score for r in quality.classify(stats, model).collect()}
    assert [got[k] for k in range(n)] == pytest.approx((1 / (1 + np.exp(np.clip(density[0] - density[1], -35, 35)))).tolist(), abs=1e-7)


def test_no_model(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("a.b", F.lit(1))
    stats = quality.document_statistics(docs)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.fit(stats, labels) is None and [r.score for r in quality.classify(stats, None).collect()] == [1.0] * 3
    assert quality.document_statistics(docs.limit(0)).count() == 0
