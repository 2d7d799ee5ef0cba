"""Substring dedup: spans of at least 13 words that an earlier document holds, found with suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, read, release, small_batches, text_bytes, written
from emberlog.llm.packed import FLUSH, PACKED, bucket_of, buckets_for, gathered, groups, packed_rows
from emberlog.llm.words import Words, hashed, mix, ngrams, seeds

WINDOW = 13
GRAM = 5
#: Words of reference text in one automaton, distinct texts that one anchor may bring to it, texts of a shard's task.
SHARD_WORDS, ANCHOR_TEXTS, SHARD_TEXTS = 20_000, 5_000, 20_000
#: In place of starts: every window of the document.
ALL = -1
ENTRY = [np.uint64, np.int64, np.int32]  # anchor, document, word number (-1: known to be in several documents)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of one document (numbers of their first words), each one's anchor (number of a 5-gram's first word), and
    5-gram hashes by first word. The anchor is the window's 5-gram of the least hash, the first of equals, so equal
    windows have equal anchors."""
    n = len(words.hash) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(words.hash) < WINDOW:
        return none, none, np.zeros(0, np.uint64)
    by = seeds(GRAM, 5)
    with np.errstate(over="ignore"):
        g = words.hash[:n] * by[0]
        for k in range(1, GRAM):
            g += words.hash[k : k + n] * by[k]
    g = mix(g)
    at, span = np.arange(n), 1
    least = lambda a, b: np.where(g[b] < g[a], b, a)
    while span * 2 <= WINDOW - GRAM + 1:
        at, span = least(at[:-span], at[span:]), span * 2
    rest = WINDOW - GRAM + 1 - span
    at = least(at[: len(at) - rest], at[rest:]) if rest else at
    start = np.flatnonzero(words.doc[: len(words.doc) - WINDOW + 1] == words.doc[WINDOW - 1 :])
    return start, at[start], g


def _send(key: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors in several of these documents are candidates at once, and their bucket only hears of them; the others ask."""
    order = np.lexsort((at, doc, key))
    key, doc, at = key[order], doc[order], at[order]
    start, count = groups(key)
    several = doc[start] != doc[start + count - 1]
    known = np.repeat(several, count)
    direct = -1 - (mix(doc[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    yield packed_rows(direct, [key[known], doc[known], at[known]])
    first = start[several]
    key, doc = np.append(key[~known], key[first]), np.append(doc[~known], doc[first])
    yield packed_rows(bucket_of(key, buckets), [key, doc, np.append(at[~known], np.full(len(first), -1)).astype(np.int32)])


def _index(buckets: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for words in hashed(batch.column("text")):
                _, at, g = anchors(words)
                at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
                doc = words.doc[at]
                waiting.append((g[at], ids[doc], (at - words.bounds()[doc - words.lo]).astype(np.int32)))
                held += len(at)
                if held >= FLUSH:
                    yield from _send(*(np.concatenate(x) for x in zip(*waiting)), buckets)
                    waiting, held = [], 0
        if held:
            yield from _send(*(np.concatenate(x) for x in zip(*waiting)), buckets)

    return apply


def _meet(table: pa.Table) -> pa.Table:
    """Word numbers of a bucket's anchors that several documents hold."""
    key, doc, at = gathered(table, ENTRY)
    if table.column("bucket")[0].as_py() >= 0:
        order = np.lexsort((at, doc, key))
        key, doc, at = key[order], doc[order], at[order]
        start, count = groups(key)
        several = (doc[start] != doc[start + count - 1]) | (np.minimum.reduceat(at, start) < 0)
        keep = np.repeat(several, count) & (at >= 0)
        doc, at = doc[keep], at[keep]
    return pa.table({"id": pa.array(doc), "at": pa.array(at)})


def joined(words: Words) -> tuple[bytes, np.ndarray]:
    """The words joined by one space each, and each word's place in that."""
    size = words.last - words.first
    start = np.append(0, np.cumsum(size + 1))
    out = np.full(start[-1], 32, np.uint8)
    byte = np.arange(int(size.sum()))
    word = np.repeat(np.arange(len(size)), size)
    inside = byte - np.repeat(np.append(0, np.cumsum(size))[:-1], size)
    out[start[word] + inside] = words.data[words.first[word] + inside]
    return out.tobytes(), start


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of windows whose anchor is a candidate: first window, number of windows, and a key of its words."""
    for batch in batches:
        ids, marks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "mark"))
        wanted = batch.column("at")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
        keys = np.sort(owner.astype(np.int64) << 32 | wanted.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        for words in hashed(batch.column("text")):
            start, at, g = anchors(words)
            if not len(start) or not len(keys):
                continue
            new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
            lo = np.flatnonzero(new)
            hi = np.append(lo[1:], len(start)) - 1
            doc, bounds = words.doc[at[lo]], words.bounds()
            asked = doc.astype(np.int64) << 32 | (at[lo] - bounds[doc - words.lo])
            place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            keep = keys[place] == asked
            lo, hi, doc = lo[keep], hi[keep], doc[keep]
            windows = hi - lo + 1
            key = run_keys(words.hash, start[lo], windows + WINDOW - 1)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(g[at[lo]].view(np.int64)), "tkey": pa.array(key.view(np.int64)), "id": pa.array(ids[doc]), "mark": pa.array(marks[doc]),
                "start": pa.array((start[lo] - bounds[doc - words.lo]).astype(np.int32)), "n": pa.array(windows.astype(np.int32)),
            })


def run_keys(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, given by first word and number of words; a run has 2 * WINDOW - GRAM words at most."""
    by = seeds(2 * WINDOW, 11)
    key = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > k)
            key[on] += h[first[on] + k] * by[k]
    return mix(key)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the runs that are asked of each document."""
    for batch in batches:
        asked, rows_of = batch.column("asked").to_pylist(), list(zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist()))
        asked = [[] if k and rows_of[k - 1] == r else x for k, (r, x) in enumerate(zip(rows_of, asked))]  # repeated rows lie together
        for words in hashed(batch.column("text")):
            text, where = joined(words)
            bounds = words.bounds()
            rows = [(x["anchor"], x["tkey"], d, int(bounds[d - words.lo]) + x["start"], x["n"]) for d in range(words.lo, words.hi) for x in asked[d]]
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array([r[0] for r in rows], pa.int64()), "tkey": pa.array([r[1] for r in rows], pa.int64()),
                "first": batch.column("id").take(pa.array([r[2] for r in rows], pa.int64())),
                "text": pa.array([text[where[a] : where[a + n + WINDOW - 1] - 1] for _, _, _, a, n in rows], pa.binary()),
            })


class Automaton:
    """A generalised suffix automaton over words; each state knows the smallest document that holds its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.first = [-1], [0], [1 << 63]

    def _state(self, size: int, link: int, follow: dict, first: int) -> int:
        self.next.append(follow), self.link.append(link), self.size.append(size), self.first.append(first)
        return len(self.size) - 1

    def _clone(self, p: int, word, q: int) -> int:
        new = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def add(self, words: list, document: int) -> None:
        last, follow, link, size, first = 0, self.next, self.link, self.size, self.first
        for word in words:
            q = follow[last].get(word)
            if q is not None:
                last = q if size[q] == size[last] + 1 else self._clone(last, word, q)
            else:
                p, last = last, self._state(size[last] + 1, 0, {}, document)
                while p >= 0 and word not in follow[p]:
                    follow[p][word] = last
                    p = link[p]
                if p >= 0:
                    q = follow[p][word]
                    link[last] = q if size[q] == size[p] + 1 else self._clone(p, word, q)
            if document < first[last]:
                first[last] = document

    def finish(self) -> None:
        """Hand each state's smallest document on to its suffixes."""
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):
            p = self.link[v]
            if p > 0 and self.first[v] < self.first[p]:
                self.first[p] = self.first[v]

    def window_firsts(self, words: list, window: int = WINDOW) -> list[int]:
        """For each window of some words, the smallest document that holds it (1 << 63 if none): matching statistics cut at the window."""
        out, v, n, follow, link, size = [], 0, 0, self.next, self.link, self.size
        for k, word in enumerate(words):
            while v and word not in follow[v]:
                v = link[v]
                n = size[v]
            v = follow[v].get(word, 0)
            n = n + 1 if v else 0
            while v and size[link[v]] >= window:
                v = link[v]
                n = size[v]
            if k >= window - 1:
                out.append(self.first[v] if n >= window else 1 << 63)
        return out


def _shard(table: pa.Table) -> pa.Table:
    """Automata of a shard's reference texts, SHARD_WORDS at a time, with all texts of the same anchors streamed through."""
    rows = sorted(zip(table.column("anchor").to_pylist(), table.column("tkey").to_pylist(), table.column("first").to_pylist(), table.column("text").to_pylist()), key=lambda x: (x[0], x[2], x[3]))
    out: list[tuple[int, int, list[int]]] = []
    part: list[tuple[int, int, list[bytes]]] = []
    automaton, held = Automaton(), 0

    def close() -> None:
        automaton.finish()
        out.extend((anchor, tkey, automaton.window_firsts(words)) for anchor, tkey, words in part)

    for k, (anchor, tkey, first, text) in enumerate(rows):
        words = text.split(b" ")
        new = not k or rows[k - 1][0] != anchor
        if new and (k + 1 == len(rows) or rows[k + 1][0] != anchor):  # the only text of its anchor: its windows are its own
            out.append((anchor, tkey, [first] * (len(words) - WINDOW + 1)))
            continue
        if new and held >= SHARD_WORDS:
            close()
            automaton, held, part = Automaton(), 0, []
        automaton.add(words, first)
        part.append((anchor, tkey, words))
        held += len(words)
    close()
    return pa.table({"anchor": pa.array([x[0] for x in out], pa.int64()), "tkey": pa.array([x[1] for x in out], pa.int64()), "firsts": pa.array([x[2] for x in out], pa.list_(pa.int64()))})


def window_firsts(distinct_texts: DataFrame, shards: int) -> DataFrame:
    """anchor, tkey and the smallest document by window, for texts (anchor, tkey, first, text)."""
    many = distinct_texts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > ANCHOR_TEXTS).select("anchor")
    none = many.isEmpty()
    few = distinct_texts if none else distinct_texts.join(many, "anchor", "left_anti")
    few = few.withColumn("shard", F.pmod("anchor", F.lit(shards)))
    found = few.groupBy("shard").applyInArrow(lambda t: _shard(t), "anchor long, tkey long, firsts array<long>")
    if none:
        return found
    # An anchor with very many texts doesn't fit a shard: its windows are grouped one by one.
    words = F.split(F.col("text").cast("string"), " ")
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.concat_ws(" ", F.slice(words, i, WINDOW)))
    wide = distinct_texts.join(many, "anchor", "left_semi").select("anchor", "tkey", "first", F.posexplode(windows).alias("k", "window"))
    least = wide.groupBy("window").agg(F.min("first").alias("least"))
    wide = wide.join(least, "window").groupBy("anchor", "tkey").agg(F.sort_array(F.collect_list(F.struct("k", "least"))).alias("x"))
    return found.unionByName(wide.select("anchor", "tkey", F.col("x.least").alias("firsts")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, total, gone = [""] * batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        starts = batch.column("starts").to_pylist()
        for words in hashed(batch.column("text")):
            text, where = joined(words)
            bounds = words.bounds()
            for d in range(words.lo, words.hi):
                lo, hi = int(bounds[d - words.lo]), int(bounds[d - words.lo + 1])
                total[d] = hi - lo
                if not starts[d]:
                    kept[d] = text[where[lo] : max(where[lo], where[hi] - 1)].decode()
                    continue
                s = np.arange(max(0, hi - lo - WINDOW + 1)) if starts[d][0] == ALL else np.unique(np.array(starts[d]))
                edge = np.bincount(s, minlength=hi - lo + 1) - np.bincount(s + WINDOW, minlength=hi - lo + 1)
                off = np.cumsum(edge[: hi - lo]) > 0
                gone[d] = int(off.sum())
                turn = np.flatnonzero(np.diff(np.concatenate([[1], off, [1]]))).reshape(-1, 2) + lo  # runs of words that stay
                kept[d] = b" ".join(text[where[a] : where[b] - 1] for a, b in turn.tolist()).decode()
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n_words": pa.array(total), "n_removed": pa.array(gone), "kept": pa.array(kept, pa.string())})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept (the words that stay, joined by one space) for each row.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id; windows are those of
    the input. The reference is the corpus itself, so its automata can't all be broadcast to all documents. Instead:
    each window has an anchor, a 5-gram of it that its content decides, so only windows with an anchor that several
    documents hold can be repeated, and their text goes to the reference shard of the anchor. A shard builds suffix
    automata of bounded size of its distinct texts, whose states know the smallest document, and streams the texts through
    them for matching statistics. Only keys of texts are shuffled to find the anchors with several; where an anchor has
    one text, its first document is known without an automaton. An anchor with very many texts is settled window by window.

    Null texts have no words. Rows with null ids neither lose words nor make others lose them. Rows that share an id
    don't cut each other; repeated rows are cut alike. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.where("id is not null and text is not null")
    total = named.agg(F.coalesce(F.sum(text_bytes(F.col("text"))), F.lit(0))).first()[0]
    index = named.mapInArrow(_index(buckets_for(total / 30)), PACKED)
    places = written(index.groupBy("bucket").applyInArrow(_meet, "id long, at int"), "repeat-places")
    del index
    release(spark)
    # A later copy of a whole text goes whole, as each of its windows is in the earlier one; nobody need look at it.
    # The join is by digest and id, so a text with very many copies isn't one task's.
    prints = named.select("id", F.xxhash64("text").alias("mark"), F.unhex(F.sha2("text", 256)).alias("print"))
    firsts = prints.groupBy("print").agg(F.min("id").alias("id"))
    lone = prints.groupBy("id").agg(F.count("*").alias("rows"), F.min("mark").alias("mark"), F.min("print").alias("print")).where("rows = 1")
    copies = written(lone.join(firsts, ["print", "id"], "left_anti").select("id", "mark"), "repeat-copies")
    wanted = places.groupBy("id").agg(F.collect_set("at").alias("at"))
    asked = named.withColumn("mark", F.xxhash64("text")).join(wanted.join(copies.select("id"), "id", "left_anti"), "id").select("id", "mark", "text", "at")
    stretches = written(asked.mapInArrow(_stretches, "anchor long, tkey long, id long, mark long, start int, n int"), "repeat-stretches")
    del asked, wanted, prints, firsts, lone
    discard(places)
    release(spark)
    # Runs of one anchor with one and the same text are their first document's; texts are only fetched, each from its
    # first document, where an anchor has several.
    heads = written(stretches.groupBy("anchor", "tkey").agg(F.min("id").alias("first"), F.min("n").alias("n"), *[F.min_by(c, "id").alias(c) for c in ("mark", "start")]), "repeat-heads")
    release(spark)
    unlike = written(heads.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeat-unlike")
    asked = heads.join(unlike, "anchor", "left_semi")
    asked = asked.groupBy(F.col("first").alias("id"), "mark").agg(F.collect_list(F.struct("anchor", "tkey", "start", "n")).alias("asked"))
    fetched = named.withColumn("mark", F.xxhash64("text")).join(asked, ["id", "mark"]).select("id", "mark", "text", "asked")
    texts = written(fetched.mapInArrow(_texts, "anchor long, tkey long, first long, text binary"), "repeat-texts")
    del asked, fetched
    release(spark)
    firsts = written(window_firsts(texts, int(max(1, texts.count() // SHARD_TEXTS))), "repeat-firsts")
    discard(texts)
    release(spark)
    alike = heads.join(unlike, "anchor", "left_anti").select("anchor", "tkey", "first", F.lit(None).cast("array<long>").alias("firsts"))
    every = alike.unionByName(firsts.select("anchor", "tkey", F.lit(None).cast("long").alias("first"), "firsts"))
    hit = stretches.join(every, ["anchor", "tkey"]).where("firsts is not null or first < id")
    here = F.filter(F.transform("firsts", lambda x, k: F.when(x < F.col("id"), F.col("start") + k)), lambda x: x.isNotNull())
    whole = F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)
    spans = hit.select("id", "mark", F.when(F.col("firsts").isNull(), whole).otherwise(here).alias("starts")).where(F.size("starts") > 0)
    spans = spans.groupBy("id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    spans = written(spans.unionByName(copies.select("id", "mark", F.array(F.lit(ALL)).alias("starts"))), "repeat-spans")
    discard(stretches, heads, unlike, firsts)
    release(spark)
    out = rows.withColumn("mark", F.xxhash64("text")).join(spans, ["id", "mark"], "left").select("id", "text", "starts")
    return out.mapInArrow(_cut, "id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
f AS (SELECT win, min(doc_id) AS first FROM g GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (win), range(13) AS r(k) WHERE first < doc_id),
x AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
