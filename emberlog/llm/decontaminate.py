"""Benchmark decontamination: a BM25 index of test items, queried with every passage by block-max WAND, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import discard, read, small_batches, written
from emberlog.llm.words import SYMBOL, Words, distinct, hashed, ngrams

K1, B = 1.2, 0.75
#: A passage is a candidate when its BM25 score reaches this share of the score of the whole item.
THRESHOLD = 0.6
#: Of the word trigrams of an item's question part, and of its answer part, so many must be in the passage.
QUESTION, ANSWER = 0.7, 0.7
#: Words of an item before this share are the question part, the others the answer part.
QUESTION_SHARE = 2 / 3
BLOCK_ITEMS = 4
#: Words of the shortest stride.
SHORTEST = 16
#: Bytes of item text in one index; a larger benchmark is cut into several, each broadcast and queried in its turn.
INDEX_BYTES = 16 << 20

#: The type of a leak, with item ids of that type.
LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


@dataclass
class Index:
    """Postings by term, weights as a share of the item's own score; maxima by term and block of items."""

    ids: list[int | None]
    terms: np.ndarray  # sorted hashes
    start: np.ndarray  # of each term's postings
    item: np.ndarray
    weight: np.ndarray
    block_start: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_max: np.ndarray
    essential: np.ndarray  # by term
    spare: np.ndarray  # by item: what the other terms add at most
    question: list[np.ndarray]
    answer: list[np.ndarray]
    stride: int

    def postings(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])

    def blocks(self, term: int) -> slice:
        return slice(self.block_start[term], self.block_start[term + 1])


def _parts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (shorter n-grams of shorter parts) of the question and of the answer."""
    n = len(words.hash)
    cut = max(1, int(np.ceil(n * QUESTION_SHARE)))
    out = []
    for lo, hi in ((0, cut), (cut, n)):
        part = Words(words.data, words.first[lo:hi], words.last[lo:hi], words.doc[lo:hi], words.hash[lo:hi], 0, 1, words.ends)
        out.append(distinct(ngrams(part, 3, salt=3)[0]))
    return out[0], out[1]


@dataclass
class Statistics:
    """Of all items of a benchmark that have words: their number and mean length; document frequencies by term."""

    n: int
    mean: float
    terms: np.ndarray  # sorted hashes, those of the index at hand at least
    df: np.ndarray


def length_class(words: int) -> int:
    """The stride of an item's passages: the least power of 2 from SHORTEST on that holds the item."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


def _read(items: list[tuple]) -> list[tuple]:
    """Id, words, distinct terms and their counts of the items that have words, in order of id and text."""
    out = []
    for item_id, text in sorted(items, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1] or "")):
        words = next(hashed(pa.array([text or ""]), lower=True, separator=SYMBOL))
        if len(words.hash):
            out.append((item_id, words, *np.unique(words.hash, return_counts=True)))
    return out


def build_indexes(items: list[tuple], threshold: float = THRESHOLD, stats: Statistics | None = None) -> list[Index]:
    """An index for each length class of the items that have words, so that the passages of an item follow its own length.

    Weights follow stats, those of all the items by default.
    """
    found, classes = _read(items), {}
    if found and stats is None:
        vocabulary, df = np.unique(np.concatenate([t for _, _, t, _ in found]), return_counts=True)
        stats = Statistics(len(found), float(np.mean([len(w.hash) for _, w, _, _ in found])), vocabulary, df)
    for x in found:
        classes.setdefault(length_class(len(x[1].hash)), []).append(x)
    return [_index_of(classes[c], threshold, stats, c) for c in sorted(classes)]


def _index_of(found: list[tuple], threshold: float, stats: Statistics, stride: int) -> Index:
    ids, terms, counts = ([x[k] for x in found] for k in (0, 2, 3))
    parts = [_parts(words) for _, words, _, _ in found]
    size = np.array([len(words.hash) for _, words, _, _ in found], float)
    item = np.repeat(np.arange(len(ids)), [len(t) for t in terms])
    every, tf = np.concatenate(terms), np.concatenate(counts).astype(float)
    vocabulary, term = np.unique(every, return_inverse=True)
    df = stats.df[np.searchsorted(stats.terms, vocabulary)]
    idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / stats.mean))
    weight /= np.bincount(item, weight)[item]
    order = np.lexsort((item, term))
    term, item, weight = term[order], item[order], weight[order]
    start = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    keys = term * (len(ids) // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    block_max = np.maximum.reduceat(weight, first)
    essential = np.ones(len(vocabulary), bool)
    rest = np.zeros(len(ids))
    for t in np.argsort(-df, kind="stable"):  # the commonest terms, as long as they can't reach half the threshold together
        own = slice(start[t], start[t + 1])
        if (rest[item[own]] + weight[own]).max() > threshold / 2:
            break
        rest[item[own]] += weight[own]
        essential[t] = False
    return Index(
        ids, vocabulary, start, item, weight, np.searchsorted(term[first], np.arange(len(vocabulary) + 1)), item[first] // BLOCK_ITEMS, block_max,
        essential, rest, [p[0] for p in parts], [p[1] for p in parts], stride,
    )


def wand(index: Index, terms: np.ndarray, threshold: float = THRESHOLD, stats: dict | None = None) -> list[tuple[int, float]]:
    """Items whose score over distinct terms reaches the threshold, by block-max WAND: (item number, score)."""
    lists = []
    for t in terms:
        p, b = index.postings(t), index.blocks(t)
        lists.append([index.item[p].tolist(), index.weight[p].tolist(), dict(zip(index.block[b].tolist(), index.block_max[b].tolist())), float(index.block_max[b].max()), 0])
    out, end, slack = [], len(index.ids), threshold - 1e-9
    here = lambda x: x[0][x[4]] if x[4] < len(x[0]) else end

    def move(x: list, to: int) -> None:
        k, items = x[4], x[0]
        while k < len(items) and items[k] < to:
            k += 1
        x[4] = k

    while True:
        lists = sorted((x for x in lists if x[4] < len(x[0])), key=here)
        bound, pivot = 0.0, None
        for k, x in enumerate(lists):
            bound += x[3]
            if bound >= slack:
                pivot = here(x)
                break
        if pivot is None:
            return out
        while k + 1 < len(lists) and here(lists[k + 1]) == pivot:
            k += 1
        head, block = lists[: k + 1], pivot // BLOCK_ITEMS
        if sum(x[2].get(block, 0.0) for x in head) < slack:  # no item of this block can do it with these terms
            after = (block + 1) * BLOCK_ITEMS
            if k + 1 < len(lists):
                after = min(after, here(lists[k + 1]))
            for x in head:
                move(x, max(after, pivot + 1))
            continue
        if stats is not None:
            stats["scored"] = stats.get("scored", 0) + 1
        for x in head:
            move(x, pivot)
        score = sum(x[1][x[4]] for x in head if here(x) == pivot)
        if score >= slack:
            out.append((pivot, score))
        for x in head:
            move(x, pivot + 1)


def _reaching(stride: np.ndarray, term: np.ndarray, start: np.ndarray, group: np.ndarray, most: np.ndarray, groups: int, least) -> np.ndarray:
    """Passages (by their first stride) in which the terms' weights for some group of items add up to `least`."""
    n = start[term + 1] - start[term]
    place = np.repeat(start[term] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
    keys = np.repeat(stride, n) * groups + group[place]
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], most[place][order]
    cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums, keys = np.add.reduceat(weight, cut), keys[cut]
    both = distinct(np.concatenate([keys, keys - groups]))  # a passage is a stride and the next one
    both = both[both >= 0]
    total = np.zeros(len(both))
    for shift in (0, groups):
        k = np.searchsorted(keys, both + shift)
        k[k == len(keys)] = 0
        total += np.where(keys[k] == both + shift, sums[k], 0.0)
    least = least if np.ndim(least) == 0 else least[both % groups]
    return distinct(both[total >= least - 1e-9] // groups)


def leaks_in(words: Words, index: Index, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> dict[int, dict[int, tuple[float, float, float]]]:
    """By document number and item number: the best score, question and answer overlap of passages that have all three.

    Passages are two strides long and start every stride, a stride being as long as the longest item of the index's length
    class, so every occurrence of an item lies whole in a passage of less than four times its length (of 2 SHORTEST words for
    the shortest).
    """
    out: dict[int, dict[int, tuple[float, float, float]]] = {}
    if not len(words.hash):
        return out
    bounds = words.bounds()
    at = np.searchsorted(index.terms, words.hash)
    at[at == len(index.terms)] = 0
    known = index.terms[at] == words.hash
    strides = -(-np.diff(bounds) // index.stride)
    first_stride = np.append(0, np.cumsum(strides))
    stride = first_stride[words.doc - words.lo] + (np.arange(len(words.hash)) - bounds[words.doc - words.lo]) // index.stride
    hit = np.flatnonzero(known & index.essential[at])
    pairs = distinct(stride[hit] * len(index.terms) + at[hit])
    s, t = pairs // len(index.terms), pairs % len(index.terms)
    # First by blocks of items, then, for the passages that are left, by items: no item is lost, as bounds are upper ones.
    passages = _reaching(s, t, index.block_start, index.block, index.block_max, len(index.ids) // BLOCK_ITEMS + 1, threshold - index.spare.max())
    near = np.isin(s, passages) | np.isin(s - 1, passages)
    passages = _reaching(s[near], t[near], index.start, index.item, index.weight, len(index.ids), threshold - index.spare)
    for p in passages.tolist():
        doc = int(np.searchsorted(first_stride, p, "right")) - 1
        lo = bounds[doc] + (p - first_stride[doc]) * index.stride
        hi = min(bounds[doc + 1], lo + 2 * index.stride)
        found = wand(index, distinct(at[lo:hi][known[lo:hi]]), threshold)
        if not found:
            continue
        part = Words(words.data, words.first[lo:hi], words.last[lo:hi], words.doc[lo:hi], words.hash[lo:hi], 0, 1, words.ends)
        grams = distinct(ngrams(part, 3, salt=3)[0])
        for item, score in found:
            q, a = (float(np.isin(x[item], grams).mean()) if len(x[item]) else 1.0 for x in (index.question, index.answer))
            if q >= question and a >= answer:
                best = out.setdefault(words.lo + doc, {})
                best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and distinct terms of each item."""
    for batch in batches:
        cuts = batch.column("cut").to_pylist()
        for words in hashed(batch.column("text"), lower=True, separator=SYMBOL):
            bounds = words.bounds()
            own = [words.hash[bounds[k] : bounds[k + 1]] for k in range(words.hi - words.lo)]
            yield pa.RecordBatch.from_pydict({
                "cut": pa.array(cuts[words.lo : words.hi], pa.int64()), "n": pa.array([len(x) for x in own], pa.int64()),
                "terms": pa.array([distinct(x).view(np.int64) for x in own], pa.list_(pa.int64())),
            })


def benchmark_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """Sets of indexes (one a length class) of at most about index_bytes of item text each, made one after the other: the driver holds one.

    Document frequencies and lengths are those of all items, so scores don't depend on how the items are cut.
    """
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= index_bytes:
        if found := build_indexes([(r["id"], r["text"]) for r in items.collect()]):  # size checked above
            yield found
        return
    cuts = -(-2 * total // index_bytes)
    items = items.withColumn("cut", F.pmod(F.xxhash64("id", "text"), F.lit(cuts)))
    terms = written(items.select("cut", "text").mapInArrow(_terms, "cut long, n long, terms array<long>").where("n > 0"), "bm25-terms")
    n, mean = terms.agg(F.count("*"), F.avg("n")).first()
    each = terms.select("cut", F.explode("terms").alias("term"))
    frequencies = written(each.groupBy("term").agg(F.count("*").alias("df")), "bm25-frequencies")
    for k in range(cuts):
        own = each.where(F.col("cut") == k).select("term").distinct().hint("merge").join(frequencies, "term").toPandas()
        own = own.assign(term=own["term"].to_numpy(np.int64).view(np.uint64)).sort_values("term")
        stats = Statistics(n, mean, own["term"].to_numpy(), own["df"].to_numpy())
        part = [(r["id"], r["text"]) for r in items.where(F.col("cut") == k).collect()]  # of bounded size, as its terms are
        if found := build_indexes(part, stats=stats):
            yield found
    discard(terms, frequencies)


def mark_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", index_bytes: int = INDEX_BYTES, out_col: str = "leaks", id_col: str = "item_id") -> DataFrame:
    """docs with a column out_col (replacing one of that name): the test items that each whole text holds.

    Null and empty texts hold nothing, and so does every text if no item has words. Items with null or empty texts are
    never found; items with equal texts are all reported. Repeated rows are marked alike. An item of fewer than three
    words in its question or answer part is verified by the other part, or by its score alone if both are so short.
    Long texts are queried by passages, all of them; those for an item follow its own length, whatever the other items are. Item ids may
    be of any type with an order. A benchmark of over index_bytes needs several indexes: what one
    found is written before the next is broadcast, so that one is alive at a time.
    """
    small_batches(docs.sparkSession)
    kind = benchmark.schema[id_col].dataType.simpleString()
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    docs = docs.withColumn(out_col, F.array().cast(LEAK.replace("bigint", kind, 1)))
    before = sent = None
    for index in benchmark_indexes(benchmark, id_col, index_bytes=index_bytes):
        if sent is not None:
            docs = written(docs, "leaks")
            sent.destroy()
            if before is not None:
                discard(before)
            before = docs
        sent = docs.sparkSession.sparkContext.broadcast(index)
        docs = _query(docs, sent, text_col, out_col)
    return docs


def _query(docs: DataFrame, sent, text_col: str, out_col: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = sent.value
        for batch in batches:
            at = batch.schema.names.index(out_col)
            had = batch.column(at).to_pylist()
            for words in hashed(batch.column(batch.schema.names.index(text_col)), lower=True, separator=SYMBOL):
                for index in indexes:
                    for doc, items in leaks_in(words, index).items():
                        had[doc] = [*(had[doc] or []), *({"item_id": index.ids[i], "score": s, "question": q, "answer": a} for i, (s, q, a) in sorted(items.items()))]
            columns = [pa.array(had, batch.schema.field(at).type) if k == at else x for k, x in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(apply, T.StructType(docs.schema.fields))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mark_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
