"""N-gram Jaccard join by token-combination prefixes: groups of documents whose five-word shingle sets link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, read, release, small_batches, text_bytes, written
from emberlog.llm.components import components
from emberlog.llm.packed import FLUSH, PACKED, bucket_of, buckets_for, gathered, groups, packed_rows
from emberlog.llm.words import Words, distinct, hashed, mix, ngrams, seeds
from emberlog.operators.skew import spread_join

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Tokens that prefixes of linked sets share at least: this share of the smaller set's size.
COMBINATION = 0.1
#: Tokens held by more sets than this are frequent; they are indexed by combinations of K.
FREQUENT, K = 16, 2
#: Documents of a family that are compared with each other, or with so many more, in one task.
BLOCK = 1024
ENTRY = [np.uint64, np.int64, np.int32, np.uint64]  # token, document, set size, set digest (0 but for a set's first token)
CLASS, PAIR, HELD, SIZE = 0, 1, 2, 3


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; with fewer words, the whole sequence as one."""
    h, at = ngrams(words, WORDS)
    doc = words.doc[at]
    bounds, cut = words.bounds(), np.searchsorted(doc, np.arange(words.lo, words.hi + 1))
    out = []
    for k in range(words.hi - words.lo):
        if cut[k + 1] > cut[k]:
            out.append(distinct(h[cut[k] : cut[k + 1]]))
            continue
        own = words.hash[bounds[k] : bounds[k + 1]]
        with np.errstate(over="ignore"):
            whole = (own * seeds(WORDS, 9)[: len(own)]).sum(keepdims=True) + np.uint64(len(own))
        out.append(mix(whole) if len(own) else own)
    return out


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """Tokens that a set of n shares at least with any set that links with it."""
    return -(-PERCENT * n // 100)


def combination(n: np.ndarray | int) -> np.ndarray:
    """Tokens that two linked sets share in their prefixes, by the size of the smaller."""
    return np.maximum(1, np.floor(COMBINATION * np.asarray(n))).astype(np.int64)


def prefix(n: int) -> int:
    """Of a set of n tokens in the global order (by hash), the first so many hold that many common ones with any linked set."""
    return min(n, int(n - needed(n) + combination(n)))


def parts(n: np.ndarray | int) -> np.ndarray:
    """Into how many parts (a power of 2) frequent tokens are dealt by hash, if the smaller set has n tokens: so few that
    one part has K of the tokens that linked sets share."""
    most = np.maximum(1, (combination(n) - 1) // (K - 1))
    return (1 << np.floor(np.log2(most)).astype(np.int64)) * (combination(n) >= K)


def _send(sets: list[tuple[int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of some documents' sets. Equal sets are combined: only the smallest id's goes on."""
    sizes = np.array([len(s) for _, s in sets], np.int64)
    ids = np.array([i for i, _ in sets], np.int64)
    with np.errstate(over="ignore"):
        digest = np.array([int((s * seeds(1, 77)[0]).sum() ^ mix(s * seeds(1, 78)[0]).sum()) if len(s) else 0 for _, s in sets], np.uint64)
    order = np.lexsort((ids, sizes, digest))
    same = np.append(False, (digest[order][1:] == digest[order][:-1]) & (sizes[order][1:] == sizes[order][:-1]))
    same &= sizes[order] > 0
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first = np.empty(len(ids), np.int64)
    first[order] = ids[order][head]
    direct = -1 - (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    zero = np.zeros(len(ids), np.uint64)
    yield packed_rows(direct, [np.full(len(ids), SIZE, np.uint64), ids, sizes.astype(np.int32), zero])
    yield packed_rows(direct, [np.full(len(ids), CLASS, np.uint64), ids, np.zeros(len(ids), np.int32), first.view(np.uint64)])
    leads = [order[k] for k in np.flatnonzero(~same) if sizes[order[k]]]
    if leads:
        lengths = np.array([prefix(int(sizes[k])) for k in leads])
        token = np.concatenate([sets[k][1][:n] for k, n in zip(leads, lengths)])
        mark = np.zeros(len(token), np.uint64)
        mark[np.append(0, np.cumsum(lengths))[:-1]] = np.maximum(digest[leads], 1)
        yield packed_rows(bucket_of(token, buckets), [token, np.repeat(ids[leads], lengths), np.repeat(sizes[leads].astype(np.int32), lengths), mark])


def _index(buckets: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, entries = [], 0
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for words in hashed(batch.column("text"), lower=True):
                for doc, found in zip(ids[words.lo : words.hi], shingle_sets(words)):
                    waiting.append((doc, found))
                    entries += len(found) // 3
                if entries >= FLUSH:
                    yield from _send(waiting, buckets)
                    waiting, entries = [], 0
        if waiting:
            yield from _send(waiting, buckets)

    return apply


def _meet(table: pa.Table) -> pa.Table:
    """What one bucket shows: equal sets, candidate pairs by rare tokens, holders of frequent tokens."""
    token, doc, size, mark = gathered(table, ENTRY)
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        kind = token.astype(np.int64)
        return _rows(kind, doc, np.where(kind == CLASS, mark.view(np.int64), size))
    out = []
    # Equal sets have equal first tokens, so they meet in one bucket.
    led = np.flatnonzero(mark)
    order = led[np.lexsort((doc[led], size[led], mark[led], token[led]))]
    new = np.ones(len(order), bool)
    new[1:] = (token[order][1:] != token[order][:-1]) | (mark[order][1:] != mark[order][:-1]) | (size[order][1:] != size[order][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    out.append(_rows(np.full(len(order), CLASS), doc[order], doc[order][head]))
    order = np.lexsort((doc, token))
    token, doc, size = token[order], doc[order], size[order].astype(np.int64)
    start, count = groups(token)
    rare = (count >= 2) & (count <= FREQUENT)
    pairs = []
    for n in np.unique(count[rare]):
        at = start[rare & (count == n)][:, None]
        for i in range(n):
            for j in range(i + 1, n):
                x, y = (at + i).ravel(), (at + j).ravel()
                fits = (100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])) & (doc[x] != doc[y])
                pairs.append(np.column_stack([doc[x[fits]], doc[y[fits]], np.minimum(size[x[fits]], size[y[fits]])]))
    if pairs:
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1))) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pairs)))
        out.append(_rows(np.full(len(first), PAIR), pairs[first, 0], pairs[first, 1], times, combination(pairs[first, 2])))
    often = np.repeat(count > FREQUENT, count)
    out.append(_rows(np.full(int(often.sum()), HELD), doc[often], token[often].view(np.int64)))
    return pa.concat_tables(out)


MET = "kind int, a long, b long, n int, need int"


def _rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, need: np.ndarray | None = None) -> pa.Table:
    none = np.zeros(len(kind), np.int32)
    counts = [none if x is None else x.astype(np.int32) for x in (n, need)]
    return pa.table({"kind": pa.array(kind.astype(np.int32)), "a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "n": pa.array(counts[0]), "need": pa.array(counts[1])})


def combined(tokens: np.ndarray, n: int) -> np.ndarray:
    """Keys of a set's combinations of K frequent tokens, by the set's size n.

    Two linked sets share combination(m) tokens or more, m being the smaller size. Dealt to parts(m) parts by hash, K of them
    fall into one part, so combinations are made within parts only, and their number grows with the set's size. A set
    of n tokens doesn't know m, which lies between the smallest size that links and n; it uses each number of parts
    that some such m has (two at most).
    """
    tokens = np.sort(tokens)
    seed, out = seeds(K + 1, 31), [np.zeros(0, np.uint64)]
    for p in {int(parts(m)) for m in (needed(n), n)}:
        if not p:  # so small that one shared token is all there is
            out.append(mix(tokens ^ seed[K]))
            continue
        part = (mix(tokens * seed[K]) % np.uint64(p)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        t, part = tokens[order], part[order]
        for k in range(1, len(t)):
            same = np.flatnonzero(part[k:] == part[:-k])
            if not len(same):
                break
            with np.errstate(over="ignore"):
                out.append(mix(t[same] * seed[0] + t[same + k] * seed[1] + np.uint64(p)))
    return distinct(np.concatenate(out))


def _combinations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide = batch.column("tokens")
        ends = np.append(0, np.cumsum(wide.value_lengths().to_numpy()))
        tokens = wide.flatten().to_numpy().view(np.uint64)
        for k, (a, n) in enumerate(zip(batch.column("a").to_pylist(), batch.column("n").to_pylist())):
            keys = combined(tokens[ends[k] : ends[k + 1]], n)
            for lo in range(0, len(keys), 1 << 20):
                found = keys[lo : lo + (1 << 20)].view(np.int64)
                m = len(found)
                yield pa.RecordBatch.from_pydict({"a": pa.array(np.full(m, a)), "token": pa.array(found), "share": pa.array(np.full(m, (ends[k + 1] - ends[k]) / n))})


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a column of lists; null lists have none."""
    column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _family(key: tuple, table: pa.Table) -> pa.Table:
    """Links that span the components of a family's block, or of two blocks, and (document, null, number of partners).

    Intersections come from blocks of a 0/1 matrix. A pair is counted in one task only: within a block where i = j, of
    the families that both documents are in the one with the least pivot, and not if a rare token has shown the link.
    """
    ids = table.column("a").to_numpy()
    sets = [s for words in hashed(table.column("text"), lower=True) for s in shingle_sets(words)]
    size = np.array([len(s) for s in sets])
    every, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    start, count = groups(every[order])
    number = np.cumsum(count >= 2) - 1
    shared = np.repeat(count >= 2, count)
    column, row = np.repeat(number, count)[shared], who[order][shared]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        a, b = np.searchsorted(column, [lo, lo + 1024])
        some = np.zeros((len(ids), 1024), np.float32)
        some[row[a:b], column[a:b] - lo] = 1
        both += some @ some.T
    parent = list(range(len(ids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, linked = [], np.zeros((len(ids), len(ids)), bool)
    for x in range(len(ids)):
        inter = both[x, x + 1 :].astype(np.int64)
        linked[x, x + 1 :] = (inter > 0) & (100 * inter >= PERCENT * (size[x] + size[x + 1 :] - inter))
        for y in np.flatnonzero(linked[x]).tolist():
            u, v = top(x), top(y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
    pivot, i, j = (k.as_py() if hasattr(k, "as_py") else k for k in key)
    if i != j:
        own = table.column("own").to_numpy()
        linked &= own[:, None] != own
    order = np.argsort(ids, kind="stable")
    x, near = _flat(table.column("near"))
    place = order[np.minimum(np.searchsorted(ids[order], near), len(ids) - 1)]
    here = ids[place] == near
    linked[x[here], place[here]] = linked[place[here], x[here]] = False
    x, pivots = _flat(table.column("pivots"))
    x, number = x[pivots < pivot], np.unique(pivots[pivots < pivot], return_inverse=True)[1]
    for lo in range(0, int(number.max(initial=-1)) + 1, 1024):
        part = (number >= lo) & (number < lo + 1024)
        some = np.zeros((len(ids), 1024), np.float32)
        some[x[part], number[part] - lo] = 1
        linked &= some @ some.T == 0
    count = linked.sum(0) + linked.sum(1)
    a, b = [x for x, _ in links], [y for _, y in links]
    some = np.flatnonzero(count)
    return pa.table({
        "a": pa.array([*a, *ids[some]], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()),
        "n": pa.array([*[0] * len(a), *count[some]], pa.int64()),
    })


def family_links(held: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b, 0) among the holders of combinations of frequent tokens, which span their components, and
    (document, null, n) with numbers of partners whose links aren't among those known already; they add up by document.

    Combinations with the same pivot (the holder with the largest share of frequent tokens, for a group of near copies
    mostly their model) make one family, so two holders of a combination meet once for a pivot and not once for a
    combination. A family is cut into blocks of about BLOCK documents, and each pair of blocks is compared in a task of its own.
    """
    pivots = held.groupBy("token").agg(F.max_by("a", F.struct("share", F.xxhash64("a"))).alias("pivot"), F.count("*").alias("n")).where("n > 1")
    pivots = written(pivots, "jaccard-pivots")
    family = spread_join(held.select("a", "token"), pivots, ["token"], "n").groupBy("pivot", "a").agg(F.count("*").alias("k")).drop("k")
    family = written(family, "jaccard-family")
    discard(pivots)
    release(docs.sparkSession)
    pivots = family.groupBy("a").agg(F.collect_list("pivot").alias("pivots"))
    near = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.collect_list("b").alias("near"))
    sizes = family.groupBy("pivot").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    family = spread_join(family, written(sizes, "jaccard-blocks"), ["pivot"], "m").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))
    family = family.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    family = family.select("pivot", "a", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.join(family.select(F.col("a").alias("id")).distinct().hint("merge"), "id", "left_semi").groupBy(F.col("id").alias("a")).agg(F.min("text").alias("text"))
    texts = texts.join(pivots, "a").join(near, "a", "left")
    found = family.join(texts, "a").groupBy("pivot", "i", "j").applyInArrow(_family, "a long, b long, n long")
    found = written(found, "jaccard-links")
    release(docs.sparkSession)
    return found


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with both texts, those that link."""
    for batch in batches:
        left, right = ([s for words in hashed(batch.column(c), lower=True) for s in shingle_sets(words)] for c in ("s", "t"))
        keep = []
        for x, y in zip(left, right):
            small, large = (x, y) if len(x) < len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), max(0, len(large) - 1))
            both = int((large[at] == small).sum()) if len(large) else 0
            keep.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the whole shingle sets of the texts of both documents."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # Nothing here has a size bound, so no side is broadcast, however small it may be now.
    texts = written(docs.join(wanted.hint("merge"), "id", "left_semi"), "jaccard-texts")
    release(docs.sparkSession)
    sides = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "s"}), "a").hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "t"}), "b")
    found = written(sides.select("a", "b", "s", "t").mapInArrow(_linked, "a long, b long").distinct(), "jaccard-links")
    discard(texts)
    release(docs.sparkSession)
    return found


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component (the smallest id reachable by links), class and its n_links, for every row with an id.

    Tokens are shingle hashes in one global order. Prefixes are extended so that two linked sets share a tenth of the
    smaller set's tokens in them, or more. A token of at most FREQUENT holders is indexed by itself: its holders are paired,
    and the pairs that share too few rare tokens, even if they shared all frequent ones that they can, go. Two sets
    that share no rare token share frequent ones only; those are indexed by combinations of K (see combined), and the holders
    of combinations meet in families (see family_links). Every pair is verified on whole sets. Equal sets are combined
    first, in each task and then by their first token, so copies are compared once. n_links is the number of other classes
    that the document's class links with; of a family's links only ones that span its components are kept.

    Null and empty texts and texts of blanks have no shingles and link with nothing. Null ids are left out. Rows that
    share an id are one document, linked by any of its texts; repeated rows give repeated results. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(text_bytes(F.col("text"))), F.lit(0))).first()[0]
    index = rows.mapInArrow(_index(buckets_for(total / 18)), PACKED)
    met = written(index.groupBy("bucket").applyInArrow(_meet, MET), "jaccard-met")
    del index
    release(spark)
    sizes = written(met.where(f"kind = {SIZE}").select(F.col("a").alias("id"), F.col("b").alias("n")), "jaccard-sizes")
    # A document's class: the smallest id of its task's equal sets, then the smallest of those.
    steps = met.where(f"kind = {CLASS}").groupBy("a", "b").agg(F.count("*").alias("k")).drop("k")
    classes = written(components(steps.where("a <> b")), "jaccard-classes").withColumnRenamed("component", "class")
    to_class = lambda df, c: df.join(classes.withColumnsRenamed({"id": c, "class": "_c"}), c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    held = written(to_class(met.where(f"kind = {HELD}").select("a", F.col("b").alias("token")), "a").distinct(), "jaccard-held")
    often = written(held.groupBy("a").agg(F.count("*").alias("f")), "jaccard-often")
    # Rare tokens in common are counted; frequent ones can add as many as the set with fewer of them has.
    pairs = met.where(f"kind = {PAIR}").groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    pairs = to_class(to_class(pairs, "a"), "b").where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.agg(F.max("n").alias("n"), F.first("need").alias("need")), "jaccard-counts")
    discard(met)
    more = pairs.where("n < need").hint("merge").join(often.withColumnRenamed("f", "fa"), "a").hint("merge").join(often.select(F.col("a").alias("b"), F.col("f").alias("fb")), "b")
    more = more.where("n + least(fa, fb) >= need")
    pairs = written(pairs.where("n >= need").select("a", "b").unionByName(more.select("a", "b")), "jaccard-pairs")
    release(spark)
    enough = often.hint("merge").join(sizes.groupBy(F.col("id").alias("a")).agg(F.max("n").alias("n")), "a")
    enough = enough.where(F.col("f") >= F.greatest(F.lit(1), F.floor(F.lit(COMBINATION) * F.floor(F.col("n") * PERCENT / 100))))
    tokens = held.hint("merge").join(enough, "a").groupBy("a").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"))
    held = written(tokens.mapInArrow(_combinations, "a long, token long, share double"), "jaccard-combinations")
    del tokens, enough, often, more
    links = verified(pairs, rows)
    ends = links.select(F.col("a").alias("class"), F.lit(1).alias("n")).unionByName(links.select(F.col("b").alias("class"), F.lit(1).alias("n")))
    if not held.isEmpty():
        found = family_links(held, rows, links)
        links = links.unionByName(found.where("b is not null").select("a", "b")).distinct()
        ends = ends.unionByName(found.where("b is null").select(F.col("a").alias("class"), "n"))
    joined = components(links).withColumnsRenamed({"id": "class"})
    degree = ends.groupBy("class").agg(F.sum("n").alias("n_links"))
    out = sizes.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    out = out.join(joined, "class", "left").join(degree, "class", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "class")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = w.doc_id
"""
