"""MinHash groups against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import minhash


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    return out


def groups(ids, sets):
    """Smallest id reachable; rows of one id are one document."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if ids[x] == ids[y] or (both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both)):
                a, b = find(ids[x]), find(ids[y])
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(spark, ids, texts, kind="long"):
    docs = spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")
    for name in ("id", "n", "key", "pivot", "lead", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted(((r.id, r.n_shingles, r.component, r.kept) for r in minhash.minhash_groups(docs).collect()), key=str)
    sets = sets_of(texts)
    there = [k for k, i in enumerate(ids) if i is not None]
    label = groups([ids[k] for k in there], [sets[k] for k in there])
    want = sorted(((i, len(s), label[i] if i is not None else None, i is None or label[i] == i) for i, s in zip(ids, sets)), key=str)
    assert got == want


def edited(words, rng, vocabulary, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("block, kind", [(256, "long"), (7, "long"), (7, "string")])
def test_groups(spark, monkeypatch, block, kind):
    """Near copies of every strength around some models, in blocks so small that unconnected members meet across them."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(block)
    v = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    texts = []
    for _ in range(6):
        model = [rng.choice(v) for _ in range(rng.randint(40, 160))]
        texts += [" ".join(edited(model, rng, v, rng.choice([0, 0.01, 0.03, 0.05, 0.08]))) for _ in range(25)]
        texts += [" ".join(model).upper(), " ".join(model) + "\n", " \t ".join(model)]
    texts += ["", None, " \n", "one", "ONE", "one two three", "one two three", "one two three four", " ".join(rng.choice(v) for _ in range(5000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    if kind == "string":
        ids = [f"d{i:04d}" for i in ids]
    else:
        ids[3], ids[40], ids[80] = None, ids[41], None  # an id with two texts, rows without an id
    check(spark, ids + ids[:5], texts + texts[:5], kind)


def test_empty(spark):
    check(spark, [], [])
    check(spark, [1, 2, None], [None, "", None])


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype(np.uint64)
        b = a.copy()
        at = rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)
        b[at] ^= np.uint64(1) + rng.integers(0, 1 << 15, len(at)).astype(np.uint64)
        keys = minhash.chunk_keys(np.stack([a, b]))
        planes = minhash.bit_planes(np.stack([a, b]))
        assert np.intersect1d(keys[0], keys[1]).size
        assert np.bitwise_count(np.bitwise_or.reduce(planes[0] ^ planes[1])) <= (a != b).sum() <= minhash.DISTANCE
