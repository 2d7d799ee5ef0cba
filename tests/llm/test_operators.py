"""Operators against brute force, on small and odd tables."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.llm import decontaminate, exact_dedup, jaccard, line_dedup, pieces, quality, repeats, sharding, toxicity, warc
from emberlog.llm.common import read, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def vocabulary(n, rng):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed():
    """Clean texts, exact and near copies, shared passages, blanks, empty and null texts, one long text."""
    rng = random.Random(3)
    v = vocabulary(400, rng)
    base = [[rng.choice(v) for _ in range(rng.randint(30, 90))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:8]:
        texts.append(" ".join(b))
        near = list(b)
        near[len(near) // 2] = "changed"
        texts.append("\n".join([" ".join(near[:20]), " ".join(near[20:])]))
    passage = " ".join(rng.choice(v) for _ in range(30))
    texts += [f"{' '.join(rng.choice(v) for _ in range(15))} {passage} {rng.choice(v)}" for _ in range(20)]
    texts += [None, "", " \t\n", "one", "one", "two words", " ".join(rng.choice(v) for _ in range(20_000))]
    return texts


CASES = {"empty": [], "nulls": [None, None, "", ""], "blank": [" ", "\n\n"], "same": ["a b c d e f g h i j k l m n"] * 5}


def sets_of(texts):
    out = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def groups_of(sets):
    label = list(range(len(sets)))
    for _ in range(len(sets)):
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
        if all(label[label[k]] == label[k] for k in range(len(sets))):
            break
    return label


@pytest.mark.parametrize("name", ["mixed", *CASES])
def test_jaccard(spark, mixed, name):
    texts = mixed if name == "mixed" else CASES[name]
    got = {r.id: (r.n_shingles, r.component) for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    sets = sets_of(texts)
    assert got == dict(enumerate(zip(map(len, sets), groups_of(sets))))


def test_jaccard_of_many_near_copies(spark):
    """More holders than FREQUENT, so families decide."""
    rng = random.Random(8)
    base, texts = [f"w{k}" for k in range(90)], []
    for k in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    got = {r.id: r.component for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    assert got == dict(enumerate(groups_of(sets_of(texts))))


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_counts_every_link(spark, block, monkeypatch):
    """Groups above FREQUENT holders, some in several families or blocks, and pairs with rare tokens in common."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(10)
    texts = []
    for group, many in enumerate((50, 30, 4)):
        base = [f"g{group}w{k}" for k in range(200)]
        for _ in range(many):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    sets = sets_of(texts)
    links = lambda x, y: 100 * len(x & y) >= jaccard.PERCENT * len(x | y)
    want = {d: sum(links(x, y) for y in sets) - 1 for d, x in enumerate(sets)}
    got = {r.id: r.n_links for r in jaccard.jaccard_groups(documents(spark, texts)).collect()}
    assert got == want and max(want.values()) > jaccard.FREQUENT


def cut(texts):
    first, words = {}, [WORDS.findall(t or "") for t in texts]
    for d, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    out = []
    for d, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for j in range(13)}
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("limit", [5_000, 1])
@pytest.mark.parametrize("name", ["mixed", *CASES])
def test_substrings(spark, mixed, name, limit, monkeypatch):
    monkeypatch.setattr(repeats, "ANCHOR_TEXTS", limit)
    texts = mixed if name == "mixed" else CASES[name]
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in repeats.substring_dedup(documents(spark, texts)).collect()}
    assert got == dict(enumerate(cut(texts)))


def test_automaton_knows_the_smallest_document():
    rng = random.Random(1)
    for _ in range(50):
        texts = [[rng.choice("ab") for _ in range(rng.randint(3, 12))] for _ in range(4)]
        automaton = repeats.Automaton()
        for d, t in enumerate(texts):
            automaton.add(t, d)
        automaton.finish()
        for t in texts:
            want = [min(d for d, x in enumerate(texts) if any(x[j : j + 3] == t[k : k + 3] for j in range(len(x) - 2))) for k in range(len(t) - 2)]
            assert automaton.window_firsts(t, 3) == want


@pytest.mark.parametrize("digest", [lambda c: F.sha2(c, 256), lambda c: F.pmod(F.length(c), F.lit(3)).cast("string")])
def test_exact(spark, digest):
    texts = ["a  b", "a b", None, "", "a\tb", "c", "cc c", "ccc "]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(documents(spark, texts), digest=digest).collect()}
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    assert got == {k: (norm.index(t), norm.count(t), norm.index(t) == k) for k, t in enumerate(norm)}
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0
    odd = documents(spark, ["x", "x", "x"], [None, 4, 4]).withColumn("id", F.lit(1)).withColumn("digest", F.lit(2))
    assert sorted((r.id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()) == [(-1, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)]


def test_best_fit_decreasing():
    rng = random.Random(2)
    items = [(rng.randint(1, 60), k) for k in range(300)]
    left, where = [], {}
    for size, k in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(c, b) for b, c in enumerate(left) if c >= size]
        b = min(fits)[1] if fits else len(left)
        left += [] if fits else [100]
        left[b] -= size
        where[k] = b
    assert dict(sharding.best_fit_decreasing(items, 100)) == where
    assert max(b for _, b in sharding.best_fit_decreasing([(150, "a"), (10, "b")], 100)) == 1


@pytest.mark.parametrize("name", ["mixed", *CASES])
def test_shards(spark, mixed, name):
    texts = mixed if name == "mixed" else CASES[name]
    rows = sharding.pack(documents(spark, texts), shards=4, slot_rows=10).collect()
    assert sorted(r.id for r in rows) == list(range(len(texts)))
    assert len({(texts[r.id] or "", r.shard) for r in rows}) == len({t or "" for t in texts})  # groups stay whole
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own))) and 0 <= shard < 4
    given = sharding.pack(documents(spark, texts), capacity=2000).groupBy("shard", "digest").agg(F.sum("size").alias("s")).groupBy("shard").agg(F.sum("s").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s <= 2000 or r.n == 1 for r in given)


def test_warc(spark, tmp_path):
    big, html = "x" * 150, "<p>é</p>"
    rows = [(3, "http://a b%", big), (1, None, big), (2, "u", html), (5, "v", html), (7, "w", None), (9, "z", "y" * 99 + "\r\n\r\n" + "q" * 30), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    index = warc.write_bundles(pages, scratch(spark, "warc"), frame_bytes=300, bundle_bytes=300)
    got = {r.page_id: r for r in warc.read_bundles(index).collect()}
    for page, url, text in rows:
        raw, r = (text or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest, r.url, r.intact) == (len(raw), hashlib.sha256(raw).hexdigest(), url, True)
        revisit = page == 3
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 1, None) if revisit else ("response", None, raw))
    found = warc.lookup(index, spark.createDataFrame([(2,), (9,), (99,)], "page_id long")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == [(2, html.encode()), (9, rows[5][2].encode())]
    for row in index.collect():
        assert (row.frame, row.offset, row.length) in warc.record_map(row.bundle)[row.record_id]
    assert warc.read_bundles(index).rdd.getNumPartitions() == index.select("bundle").distinct().count() > 1
    twice = spark.createDataFrame([(None, "a", big), (None, "b", big), (5, "c", html), (5, "d", big), (5, "d", big), (6, "e", "z" * 5_000_000)], "page_id long, url string, html string")
    found = warc.write_bundles(twice, scratch(spark, "warc"))
    assert len({r.record_id for r in found.collect()}) == 5 and sorted(r.payload_bytes for r in warc.read_bundles(found).collect()) == [9, 150, 150, 150, 150, 5_000_000]
    empty = warc.write_bundles(pages.limit(0), scratch(spark, "warc"))
    assert empty.count() == 0 and warc.read_bundles(empty).count() == 0


def all_paths(v, text):
    """Every segmentation of a short text with its score."""
    words, out = [], [(0.0, ())]
    for w in re.findall(" +[^ ]*", " " + text) if text else []:
        lead = len(w) - len(w.lstrip(" "))
        into = v.lattice("▁" * lead + w.lstrip(" "), lead)
        paths = {0: [(0.0, ())]}
        for j in range(1, len(into)):
            paths[j] = [(s + t, p + ids) for i, t, ids in into[j] for s, p in paths[i]]
        words.append(paths[len(into) - 1])
    for w in words:
        out = [(s + t, p + q) for s, p in out for t, q in w]
    return sorted(out, key=lambda x: -x[0])


def test_pieces(spark):
    v = pieces.Vocabulary.load()
    texts = ["the cat", "a", "", " x  y ", "é\nñ▁ z", "日本 ok", "hello\tworld"]
    for t in texts:
        ids, ends, scores, others = pieces.Encoder(v, 4).encode([t])
        want = all_paths(v, t)[:4]
        assert [scores[0], *(o["score"] for o in others[0])] == pytest.approx([s for s, _ in want])
        for o in others[0]:
            changed = ids.tolist()
            for e in sorted(o["edits"], key=lambda e: -e["start"]):
                changed[e["start"] : e["stop"]] = e["ids"]
            assert pieces.decode_ids(changed, v.names) == t
    rng = random.Random(4)
    texts += [None, "".join(rng.choice("abc de\n") for _ in range(30_000)), "q" * 3000]
    docs = documents(spark, texts).withColumn("encoded", F.lit(1))
    rows = pieces.decode(pieces.encode(docs).select("doc_id", "text", "encoded.ids")).collect()
    assert all(r.text == r.decoded for r in rows) and len(rows) == len(texts)
    assert pieces.encode(documents(spark, [])).count() == 0


def test_pieces_are_decoded(spark, sf_dir, monkeypatch):
    import corpus_pipeline as p

    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    rows = pieces.op2_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.round_trip and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    docs = documents(spark, ["é\nñ▁ z", "", None])
    assert [r.round_trip for r in p.pieces(spark, docs, sf_dir).orderBy("doc_id").collect()] == [True, True, None]
    lossy = pieces.spellings
    monkeypatch.setattr(pieces, "spellings", lambda names: [x.replace(b" ", b"") for x in lossy(names)])
    assert [r.round_trip for r in pieces.round_trip(documents(spark, ["a b"])).collect()] == [False]


def test_patience():
    a, b = [1, 2, 3, 4, 5, 6], [9, 1, 2, 7, 3, 4, 6, 6]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (2, 4), (3, 5), (5, 7)]
    assert line_dedup.patience([], b) == [] and line_dedup.patience(a, a) == [(k, k) for k in range(6)]
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[x] == b[y] for x, y in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


def test_lines(spark):
    line = [f"this is the shared line number {k}" for k in range(6)]
    texts = ["\n".join(line[:3]), "start here\n" + line[1] + " \n\n" + line[2], line[5] + "\nshort", "short\nnew " + line[5], "x\n" + line[5], None, "", "\n".join(line[:3])]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.lang) for r in line_dedup.line_dedup(documents(spark, texts)).collect()}
    assert got[0] == (texts[0], 3, 0, "en") and got[1] == ("start here\n", 4, 2, "en")
    assert got[3][2] == 0 and got[4] == ("x", 2, 1, "en") and got[5] == (None, 0, 0, "en") and got[6] == ("", 1, 0, "en") and got[7] == ("", 3, 3, "en")
    odd = documents(spark, ["a\n" + line[0], line[0], line[0], line[0]], [1, 2, 2, None]).withColumn("line", F.lit(1)).withColumn("mark", F.lit(1))
    assert sorted((r.doc_id or -1, r.n_removed) for r in line_dedup.line_dedup(odd).collect()) == [(-1, 0), (1, 0), (2, 1), (2, 1)]
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_common_lines(monkeypatch):
    rng = random.Random(5)
    for limit in (1 << 28, 8):
        monkeypatch.setattr(line_dedup, "LCS_BITS", limit)
        for _ in range(200):
            a, b = ([rng.randrange(1, 4) for _ in range(rng.randrange(12))] for _ in range(2))
            n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
            found = sorted(line_dedup.common(a, b))
            assert len(found) == n[-1][-1] and all(a[x] == b[y] for x, y in found)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert line_dedup.patience([1, 2, 3, 2, 4], [5, 2, 2, 6]) == [(1, 1), (3, 2)]


def overlap(a, b):
    a, b = [x for x in a if x], [x for x in b if x]
    return any(len(x) >= 20 or {*b} == {x} for x in {*a} & {*b}) or bool({*zip(a, a[1:])} & {*zip(b, b[1:])})


def test_short_lines_propose_pairs(spark):
    texts = ["one\ntwo\nthree\n早上好", "new\n\none\n\ntwo\nold", "早上好", "one\ntwo\nthree\n早上好", "three\none", "x", " x\nx"]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, texts)).collect()}
    assert got == dict(enumerate([texts[0], "new\n\n\nold", "", "", "three\none", "x", "x"]))


def test_lines_meet_every_earlier_holder(spark):
    """Against all pairs of overlapping documents: lines out of order in the first holder align with a later one."""
    line = [f"this is the shared line number {k}" for k in range(9)]
    rng = random.Random(12)
    texts = ["\n".join(line[:2]), "\n".join(line[1::-1]), "\n".join(line[1::-1])]
    texts += ["\n".join(rng.choice([*line, "", "short"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    lines = [[x.strip() for x in t.split("\n")] for t in texts]
    number = {x: k for k, x in enumerate(["", *line, "short"])}
    coded = [[number[x] for x in t] for t in lines]
    want = {}
    for d, b in enumerate(coded):
        gone = {y for e in range(d) if overlap(lines[e], lines[d]) for y in line_dedup.aligned_blocks(coded[e], b)}
        if coded.index(b) < d:
            gone = set(range(len(b))) - {k for k, x in enumerate(b) if x == line_dedup.BLANK}
        want[d] = "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in gone)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(spark, texts)).collect()}
    assert got[2] == "" and got == want


def test_wand_is_exact():
    rng = random.Random(7)
    v = vocabulary(60, rng)
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(4, 12)))) for k in range(40)]
    (index,) = decontaminate.build_indexes(items)
    import numpy as np

    for _ in range(100):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), 12)))
        score = np.zeros(len(items))
        for t in terms:
            score[index.item[index.postings(t)]] += index.weight[index.postings(t)]
        want = {int(k): pytest.approx(score[k]) for k in np.flatnonzero(score >= 0.4 - 1e-9)}
        assert dict(decontaminate.wand(index, terms, 0.4)) == want


def test_leaks(spark):
    rng = random.Random(9)
    v = vocabulary(3000, rng)
    say = lambda n: " ".join(rng.choice(v) for _ in range(n))
    items = [(k, say(rng.randint(12, 50))) for k in range(30)] + [(None, say(20)), (31, None), (32, "")]
    texts = [say(300) for _ in range(20)] + [say(rng.randint(0, 400)) + " " + items[k][1].upper() + ", " + say(40) for k in range(31)] + [None, "", items[0][1].rsplit(" ", 12)[0]]
    docs = documents(spark, texts).withColumn("leaks", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, leak.item_id) for r in decontaminate.mark_leaks(docs, bench).collect() for leak in r.leaks}
    assert got == {(20 + k, items[k][0]) for k in range(31)}
    assert decontaminate.mark_leaks(docs, bench.limit(0)).where("size(leaks) > 0").isEmpty()


def test_leaks_by_several_indexes(spark):
    """Items with edits of every strength, so that some scores lie near the threshold: one index and several agree."""
    rng = random.Random(11)
    v = vocabulary(400, rng)
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(6, 30)))) for k in range(40)]
    edited = lambda text, share: " ".join(rng.choice(v) if rng.random() < share else w for w in text.split())
    texts = [" ".join(rng.choice(v) for _ in range(60)) + " " + edited(items[k][1], 0.05 * (k % 5)) for k in range(40)] + [None, ""]
    bench = spark.createDataFrame([*items, (40, None), (41, "...")], "item_id long, text string")
    total = sum(len(t) for _, t in items)
    found = []
    for index_bytes in (total, total // 3):
        rows = decontaminate.mark_leaks(documents(spark, texts), bench, index_bytes=index_bytes).collect()
        found.append({(r.doc_id, x.item_id): (round(x.score, 9), x.question, x.answer) for r in rows for x in r.leaks})
    assert found[0] == found[1] and 8 <= len(found[0]) < 40


def test_classifiers(spark, sf_dir):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    stats = quality.document_statistics(docs)
    found = quality.classify(stats, quality.fit(stats, labels)).join(labels.withColumnRenamed("doc_id", "id"), "id")
    held = found.where(F.crc32(F.col("id").cast("string")) % 3 == 1)
    assert held.where("(score >= 0.5) = (quality = 1)").count() >= 0.97 * held.count()
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    toxic, clean = ([r.toxicity for r in rows if r.toxic == t] for t in (1, 0))
    assert sum(x >= 0.5 for x in toxic) >= 0.75 * len(toxic) and sum(x < 0.5 for x in clean) >= 0.99 * len(clean)
    odd = documents(spark, [None, "", "word " * 50_000]).withColumn("toxicity", F.lit("x"))
    for m in (model, None):
        assert all(0 <= r.toxicity <= 1 for r in toxicity.score(odd, m).collect())
    assert toxicity.train(docs, labels.limit(0)) is None and quality.fit(stats, labels.where("quality = 1")) is None
    odd_stats = quality.document_statistics(documents(spark, [None, "", "w " * 50_000]))
    assert all(0 <= r.score <= 1 for r in quality.classify(odd_stats, quality.fit(stats, labels)).collect())


def plain_lines(rows):
    """Line dedup of (id, text) rows with all earlier overlapping documents, one pair after the other."""
    number = {"": 0}
    code = lambda t: [number.setdefault(x.strip(" \t\n\x0b\x0c\r"), len(number)) for x in t.split("\n")]
    rows = sorted(rows)
    said = {d: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for d, t in rows}
    coded = {d: code(t or "") for d, t in rows}
    holders, out = {}, {}
    keys = lambda d: {*said[d], *zip([x for x in said[d] if x], [x for x in said[d] if x][1:])} - {""}
    firsts = {}
    for d, t in rows:
        if t is None:
            out[d] = None
            continue
        whole = tuple(coded[d])
        near = set().union(*(holders.get(k, set()) for k in keys(d))) if keys(d) else set()
        gone = {y for e in near if overlap(said[e], said[d]) for y in line_dedup.aligned_blocks(coded[e], coded[d])}
        if whole in firsts:
            gone = {k for k, x in enumerate(coded[d]) if x}
        else:
            firsts[whole] = d
            for k in keys(d):
                holders.setdefault(k, set()).add(d)
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
    return out


def test_pipeline_rows_against_plain_stages(spark):
    """run() against the same decisions in plain Python; the toxicity scores are those of the operator, tested by itself."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    model = toxicity.train(docs, read(spark, sf, "labels"))
    rows = [(r.doc_id, r.text) for r in toxicity.score(docs, model).collect() if r.toxicity < 0.5]
    texts = plain_lines(rows)
    ids = sorted(texts)
    sets = sets_of([texts[d] for d in ids])
    label = groups_of(sets)
    ids = [d for k, d in enumerate(ids) if label[k] == k]
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [" ".join(words(r.text)) for r in read(spark, sf, "benchmark").collect() if words(r.text)]
    ids = [d for d in ids if not any(f" {x} " in f" {' '.join(words(texts[d]))} " for x in items)]
    found = {r.doc_id: (r.decoded_sha256, r.round_trip) for r in p.run(spark, sf).collect()}
    assert found == {d: (None if texts[d] is None else hashlib.sha256(texts[d].encode()).hexdigest(), None if texts[d] is None else True) for d in ids}


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents").unionByName(documents(spark, [None, "", None], [10_000, 10_001, None]))
    for name, stage in p.STAGES:
        path = scratch(spark, "stage")
        stage(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != p.STAGES[-1][0]:
            assert after.columns == docs.columns and after.count() <= docs.count()
            docs = after
    assert {"doc_id", "ids", "n_pieces"} <= set(after.columns) and after.count() == docs.count()
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_line_dedup_of_odd_tables(spark):
    """Clashing names, texts of very many lines, nulls and repeated rows."""
    many = "\n".join(f"a long line with the number {k} in it" for k in range(30_000))
    docs = documents(spark, [many, many + "\nand one more line at the very end", None, "", "\t\n  ", "\t\n  "])
    for name in ("id", "mark", "cut", "row", "lines", "parts", "key", "first", "__line_cut", "a.b"):
        docs = docs.withColumn(name, F.lit(1))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(docs.unionByName(docs)).collect()}
    assert got[0] == (many, 30_000, 0) and got[1] == ("and one more line at the very end", 30_001, 30_000)
    assert got[2] == (None, 0, 0) and got[3] == ("", 1, 0) and got[4] == got[5] == ("\t\n  ", 2, 0)
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]


def test_combinations_meet():
    """Sets that share as many frequent tokens as their sizes demand have a combination in common."""
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(300):
        small = int(rng.integers(1, 400))
        large = int(rng.integers(small, 100 * small // jaccard.PERCENT + 1))
        shared = rng.integers(0, 1 << 63, int(jaccard.combination(small)), dtype=np.uint64)
        a, b = (np.concatenate([shared, rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)]) for _ in range(2))
        assert np.intersect1d(jaccard.combined(a, small), jaccard.combined(b, large)).size


def test_ftrl_against_plain_python():
    """One coordinate after the other, with plain floats."""
    import math

    import numpy as np

    rng = random.Random(3)
    examples = [(np.array(sorted(rng.sample(range(40), 6))), float(rng.random() < 0.5)) for _ in range(200)]
    examples = [(s, 1.0 if 3 in s else y) for s, y in examples]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.01
    z, n = [0.0] * 65, [0.0] * 65

    def weight(k):
        cut = 0.0 if k == 64 else l1
        return 0.0 if abs(z[k]) <= cut else -(z[k] - math.copysign(cut, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(2):
        for slots, label in examples:
            at = [*slots.tolist(), 64]
            w = [weight(k) for k in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for k, v in zip(at, w):
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * v
                n[k] += g * g
    model = toxicity.ftrl(examples, bits=6, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=2)
    assert model.dense() == pytest.approx([weight(k) for k in range(64)]) and model.bias == pytest.approx(weight(64))
    assert 0 < len(model.slots) < 40


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op1_toxicity(spark, sf).where("held_out").join(read(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == t] for t in (1, 0))
    assert len(toxic) > 50 and sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.01 * len(clean)
