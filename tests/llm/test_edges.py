"""Column names that clash, items of very unlike lengths, texts without spaces, page lines in several orders."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, line_dedup, pieces
from emberlog.llm.common import read, scratch

DOCS = "doc_id long, text string"
NAMES = ("toxicity", "leaks", "score", "n_lines", "n_removed", "encoded", "decoded", "ids", "row", "id", "a.b")


def test_pipeline_keeps_other_columns(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    for k, name in enumerate(NAMES):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in p.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        kept = [c for c in docs.columns if c not in ("text", "n_chars")]
        if name != p.STAGES[-1][0]:
            assert after.columns == docs.columns
            docs = after
        assert set(kept) <= set(after.columns)
        assert [tuple(r) for r in after.select(*[F.col(f"`{n}`") for n in NAMES]).distinct().collect()] == [tuple(range(len(NAMES)))]
    assert {"encoded_score", "encoded_ids", "n_pieces"} <= set(after.columns)


def item(rng, v, n):
    return " ".join(rng.choice(v) for _ in range(n))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_leaks_do_not_follow_other_items(spark, kind):
    """An item in pieces far apart isn't found and items as a whole are, with or without an unrelated item of 5,000 words; brute force by substrings."""
    rng = random.Random(21)
    v = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(4000)]
    items = [(k, item(rng, v, n)) for k, n in enumerate([5, 16, 17, 30, 40, 100, 300])]
    texts = [item(rng, v, 150) + " " + t + " " + item(rng, v, 100) for _, t in items] + [item(rng, v, 400) for _ in range(5)]
    words = items[3][1].split()
    texts.append(f" {item(rng, v, 300)} ".join(" ".join(words[k : k + 10]) for k in (0, 10, 20)))
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = []
    for more in ([], [(99, item(rng, v, 5000))]):
        bench = spark.createDataFrame([*items, *more], "item_id long, text string").withColumn("item_id", F.col("item_id").cast(kind))
        found.append(sorted((r.doc_id, int(x.item_id)) for r in decontaminate.mark_leaks(docs, bench).collect() for x in r.leaks))
    assert found[0] == found[1] == [(d, k) for d, t in enumerate(texts) for k, i in items if f" {i} " in f" {t} "] == [(k, k) for k in range(7)]


def test_texts_without_spaces(monkeypatch):
    """Lattices in small parts against the whole lattice's paths; a long word's edits give the other paths."""
    monkeypatch.setattr(pieces, "PART", 7)
    vocabulary = pieces.Vocabulary.load()
    encoder, rng = pieces.Encoder(vocabulary), random.Random(2)
    for _ in range(60):
        lead, word = rng.randint(0, 3), "".join(rng.choice("abcthein019é日▁😀") for _ in range(rng.randint(1, 90)))
        whole = pieces.n_best(vocabulary.lattice(pieces.MARK * lead + word, lead), 4)
        found = pieces.LongLattice(vocabulary, encoder.matcher, word, lead).n_best(4)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in whole]) and len({ids for _, ids in found}) == len(found)
    word = "".join(rng.choice("abcthein019") for _ in range(300))
    ids, _, (score,), (others,) = encoder.encode([word])
    want = pieces.n_best(vocabulary.lattice(pieces.MARK + word, 1), 4)
    assert [score, *(x["score"] for x in others)] == pytest.approx([s for s, _ in want])
    for x in others:
        path = ids.tolist()
        for e in sorted(x["edits"], key=lambda e: -e["start"]):
            path[e["start"] : e["stop"]] = e["ids"]
        assert pieces.decode_ids(path, vocabulary.names) == word and path != ids.tolist()


def test_page_lines_bring_few_pairs(spark, monkeypatch):
    """Two lines in two orders: pairs grow with the documents, and both lines go."""
    met = []
    monkeypatch.setattr(line_dedup, "_aligned", lambda pairs, *x, old=line_dedup._aligned: met.append(pairs.count()) or old(pairs, *x))
    a, b, n = "the first line of every page's foot", "the second line of every page's foot", 60
    texts = ["\n".join([f"a line of document {k} alone", *(a, "", f"more of {k} and of no other", b)[:: 1 if k % 2 else -1], f"the end of {k} and of it alone"]) for k in range(n)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {0: 0, 1: 1} | {k: 2 for k in range(2, n)} and sum(met) < 3 * n
