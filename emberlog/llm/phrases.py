"""Phrase collocation mining: SPAM-style position bitmaps of words, extended by shift, AND and popcount."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.common import discard, read, release, small_batches, text_bytes, written
from emberlog.llm.packed import PACKED, bucket_of, buckets_for, gathered, groups, pack, unpack
from emberlog.llm.words import LOWER, hashed, seeds, slices, utf8
from emberlog.llm.words import mix as mixed
from emberlog.operators.skew import spread_join

LONGEST, SUPPORT, TOP = 5, 100, 2000
#: Words of one shard, positions of one bitmap block, positions of the first words that are extended at once.
SHARD_WORDS, BLOCK, AT_ONCE = 1_000_000, 16, 50_000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True


# Shards: words as numbers, and a shard's own vocabulary.


def pieces_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of each word of some texts, and the number of the piece that it is in."""
    n = len(data)
    word = ~(_BREAK[data] | _SPACE[data])
    starts, stops = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    cut = ends[(ends > 0) & (ends < n)]
    starts[cut] |= word[cut]
    stops[cut - 1] |= word[cut - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    piece = np.cumsum(_BREAK[data])[first] + np.searchsorted(ends, first, "right")
    return first, last, piece


def spelled(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """The words as an Arrow array; all bytes outside them are left out."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[first] = 1
    np.add.at(inside, last, -1)
    kept = np.ascontiguousarray(data[np.cumsum(inside[:-1]).astype(bool)])
    at = np.append(0, np.cumsum(last - first)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(kept)])


def _shard(words: list[pa.Array], langs: list[np.ndarray], gaps: list[np.ndarray], buckets: int) -> tuple[bytes, int, list[tuple[int, int, bytes]], np.ndarray]:
    """A shard's positions (a number from 1 for each word and lang, 0 between pieces), its vocabulary as packed rows (bucket, n,
    blob) and words by lang. Numbers go up by bucket, so a row's words have numbers in a row."""
    coded = pa.chunked_array(words).combine_chunks()
    coded = (pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded).dictionary_encode()
    lang, gap, different = np.concatenate(langs), np.concatenate(gaps), len(coded.dictionary)
    kinds, number, count = np.unique(lang * different + coded.indices.to_numpy().astype(np.int64), return_inverse=True, return_counts=True)
    spelling = np.concatenate([w.hash for w in hashed(coded.dictionary)])
    bucket = bucket_of(spelling[kinds % different], buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    at = np.arange(len(number)) + np.cumsum(gap)
    line = np.zeros(int(at[-1]) + 1, np.int32)
    line[at] = place[number]
    texts = coded.dictionary.take(pa.array(kinds[order] % different)).to_pylist()
    start, n = groups(bucket[order])
    packed = [(int(bucket[order][x]), int(m), _vocabulary(count[order][x : x + m], (kinds[order] // different)[x : x + m], texts[x : x + m])) for x, m in zip(start, n)]
    return zstandard.ZstdCompressor(level=1).compress(line.tobytes()), len(line), packed, np.bincount(lang)


def _vocabulary(count: np.ndarray, lang: np.ndarray, words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(count.astype(np.int64).tobytes() + lang.astype(np.int32).tobytes() + b"\n".join(words))


SHARDS = "shard string, positions long, line binary, bucket int, n long, blob binary, names array<string>, lang string"


def _rows(**columns: list) -> pa.RecordBatch:
    kinds = {"shard": pa.string(), "positions": pa.int64(), "line": pa.binary(), "bucket": pa.int32(), "n": pa.int64(), "blob": pa.binary(), "names": pa.list_(pa.string()), "lang": pa.string()}
    many = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(many, t) for c, t in kinds.items()], list(kinds))


def _encode(buckets: int):
    """A row for each shard, one for each bucket of its vocabulary, and one for each lang in it."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, waiting, held = TaskContext.get().partitionId(), 0, [], 0
        known: dict[str, int] = {}

        def send() -> Iterator[pa.RecordBatch]:
            line, positions, packed, by_lang = _shard(*(list(x) for x in zip(*waiting)), buckets)
            shard, names = f"{task}-{made}", list(known)
            yield _rows(shard=[shard], positions=[positions], line=[line])
            yield _rows(shard=[shard] * len(packed), bucket=[b for b, _, _ in packed], n=[n for _, n, _ in packed], blob=[x for _, _, x in packed], names=[names] * len(packed))
            there = np.flatnonzero(by_lang)
            yield _rows(lang=[names[k] for k in there], n=by_lang[there].tolist())

        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            lang = np.array([known.setdefault(x, len(known)) for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi in slices(offsets):
                data, ends = LOWER[raw[offsets[lo] : offsets[hi]]], offsets[lo : hi + 1] - offsets[lo]
                first, last, piece = pieces_of(data, ends)
                if not len(first):
                    continue
                gap = np.append(True, piece[1:] != piece[:-1]).astype(np.int64)
                waiting.append((spelled(data, first, last), lang[np.searchsorted(ends, first, "right") - 1 + lo], gap))
                held += len(first)
                if held >= SHARD_WORDS:
                    yield from send()
                    made, waiting, held = made + 1, [], 0
        if held:
            yield from send()

    return apply


WORDS = "lang string, word binary, word_id long, a long, shard string, bucket int, codes binary"


def _frequent_words(support: int):
    """Of one bucket, the words of enough count over all shards, numbered; and for each shard the numbers of its words there (0: rare)."""

    def apply(table: pa.Table) -> pa.Table:
        bucket, rows = table.column("bucket")[0].as_py(), table.select(["shard", "n", "blob", "names"]).to_pylist()
        counts, langs, words, known = [], [], [], {}
        for r in rows:
            raw, n = zstandard.ZstdDecompressor().decompress(r["blob"]), r["n"]
            counts.append(np.frombuffer(raw, np.int64, n))
            own = np.array([known.setdefault(x, len(known)) for x in r["names"]], np.int64)
            langs.append(own[np.frombuffer(raw, np.int32, n, 8 * n)])
            words += raw[12 * n :].split(b"\n")
        coded = pa.array(words, pa.binary()).dictionary_encode()
        different = len(coded.dictionary)
        kinds, at = np.unique(np.concatenate(langs) * different + coded.indices.to_numpy().astype(np.int64), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(kinds)).astype(np.int64)
        often = np.flatnonzero(total >= support)
        code = np.zeros(len(kinds), np.int32)
        code[often] = np.arange(1, len(often) + 1)
        names, f, m = list(known), len(often), len(rows)
        ends = np.cumsum([0, *(r["n"] for r in rows)])
        back = [zstandard.ZstdCompressor(level=1).compress(code[at[x:y]].tobytes()) for x, y in zip(ends, ends[1:])]
        texts = coded.dictionary.take(pa.array(kinds[often] % different)).to_pylist()
        return pa.table({
            "lang": pa.array([names[k] for k in kinds[often] // different] + [None] * m, pa.string()), "word": pa.array(texts + [None] * m, pa.binary()),
            "word_id": pa.array((bucket << 32 | code[often].astype(np.int64)).tolist() + [None] * m, pa.int64()), "a": pa.array(total[often].tolist() + [None] * m, pa.int64()),
            "shard": pa.array([None] * f + [r["shard"] for r in rows], pa.string()), "bucket": pa.array([None] * f + [bucket] * m, pa.int32()), "codes": pa.array([None] * f + back, pa.binary()),
        })

    return apply


# Bitmaps: blocks of positions, and in each block the words that are there with a bit for each of their places.


class Bitmaps:
    """The position bitmaps of a line of numbers, 0 being no word: compressed to the blocks where a word is, in block order."""

    def __init__(self, line: np.ndarray, words: int):
        at = np.flatnonzero(line)
        key = (at // BLOCK) * (words + 1) + line[at]
        order = np.argsort(key, kind="stable")
        start, count = groups(key[order])
        self.bits = np.bitwise_or.reduceat(np.left_shift(1, at % BLOCK)[order], start).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)
        self.block, self.word = np.divmod(key[order][start], words + 1)
        self.cut = np.searchsorted(self.block, np.arange(len(line) // BLOCK + 3))
        self.words = words

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps (phrase, block, bits) of last words, shifted by one position and ANDed with those of all words that are
        in the same blocks: rows (phrase, next word, block, bits) that aren't empty."""
        moved = bits << np.uint32(1)
        over = np.flatnonzero(moved >> np.uint32(BLOCK))
        phrase, block = np.append(phrase, phrase[over]), np.append(block, block[over] + 1)
        bits = np.append(moved & np.uint32((1 << BLOCK) - 1), np.ones(len(over), np.uint32))
        size = self.cut[block + 1] - self.cut[block]
        row = np.repeat(np.arange(len(block)), size)
        other = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.cut[block], size)
        both = bits[row] & self.bits[other]
        some = np.flatnonzero(both)
        return phrase[row[some]], self.word[other[some]], block[row[some]], both[some]

    def firsts(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bitmaps of single words, a bounded run of words at a time."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        lo = 0
        while lo < len(word):
            hi = int(np.searchsorted(word, word[min(lo + AT_ONCE, len(word)) - 1], "right"))
            for k in range(lo, hi, 4 * AT_ONCE):  # one very common word is cut as well
                some = order[k : min(hi, k + 4 * AT_ONCE)]
                yield self.word[some], self.block[some], self.bits[some]
            lo = hi


def pairs_in(line: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all pairs of neighbours, by popcount: first word, second word, count."""
    maps, out = Bitmaps(line, words), []
    for word, block, bits in maps.firsts():
        first, second, _, both = maps.extended(word, block, bits)
        out.append(_counted(first * (words + 1) + second, both))
    key = np.concatenate([k for k, _ in out]) if out else np.zeros(0, np.int64)
    n = np.concatenate([c for _, c in out]) if out else np.zeros(0, np.int64)
    kinds, at = np.unique(key, return_inverse=True)
    return kinds // (words + 1), kinds % (words + 1), np.bincount(at, n, len(kinds)).astype(np.int64)


def _counted(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    start, _ = groups(key[order])
    ones = np.bitwise_count(bits).astype(np.int64)[order]
    return key[order][start], np.add.reduceat(ones, start) if len(start) else np.zeros(0, np.int64)


def longer_phrases(line: np.ndarray, words: int, follows: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 3 words and more (rows of numbers, 0 beyond the end) with their counts, a run of first words at a time.

    Depth first: a run's phrases are extended up to the longest before the next run begins, so memory follows the run.
    follows: the frequent pairs, as sorted first * (words + 1) + second; a phrase is extended along these only. A phrase may
    come several times with parts of its count.
    """
    maps = Bitmaps(line, words)
    for word, block, bits in maps.firsts():
        phrases, phrase = np.unique(word, return_inverse=True)
        phrases = phrases[:, None]
        for length in range(2, longest + 1):
            phrase, following, block, bits = maps.extended(phrase, block, bits)
            pair = phrases[phrase, -1] * (words + 1) + following
            fits = follows[np.minimum(np.searchsorted(follows, pair), len(follows) - 1)] == pair if len(follows) else np.zeros(len(pair), bool)
            key, block, bits = (phrase * (words + 1) + following)[fits], block[fits], bits[fits]
            kinds, phrase = np.unique(key, return_inverse=True)
            if not len(kinds):
                break
            phrases = np.column_stack([phrases[kinds // (words + 1)], kinds % (words + 1)])
            if length > 2:
                count = np.bincount(phrase, np.bitwise_count(bits), len(kinds)).astype(np.int64)
                yield np.pad(phrases, ((0, 0), (0, longest - length))), count


def recoded(line: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line with frequent words as 1, 2, … and 0 for the others, and the sorted ids that these stand for. ids: of each number of
    the line from 1 on, 0 for a rare word."""
    often = np.flatnonzero(ids)
    order = often[np.argsort(ids[often])]
    to = np.zeros(len(ids) + 1, np.int64)
    to[order + 1] = np.arange(1, len(order) + 1)
    return to[line], ids[order]


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Shard, line of frequent words, and their ids."""
    zstd = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        line = np.frombuffer(zstd.decompress(batch.column("line")[k].as_py()), np.int32, batch.column("positions")[k].as_py())
        parts = sorted(((r["bucket"], r["codes"]) for r in batch.column("words")[k].as_py()))
        codes = [(b, np.frombuffer(zstd.decompress(c), np.int32).astype(np.int64)) for b, c in parts]
        yield batch.column("shard")[k].as_py(), *recoded(line, np.concatenate([np.where(c > 0, b << 32 | c, 0) for b, c in codes]))


# Jobs over shards.

PAIRS = "shard string, bucket int, n long, blob binary"


def _shard_pairs(line: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, first and second word (numbers of the line) and count of a shard's pairs of frequent words, in order of bucket."""
    a, b, n = pairs_in(line, len(ids))
    with np.errstate(over="ignore"):
        h = mixed(ids[a - 1].view(np.uint64) * seeds(2, 12)[0] + ids[b - 1].view(np.uint64) * seeds(2, 12)[1])
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], a[order], b[order], n[order]


def _pairs(buckets: int):
    """Counts of all pairs of frequent words of each shard, packed by bucket."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, line, ids in _lines(batch):
                bucket, a, b, n = _shard_pairs(line, ids, buckets)
                first, second = ids[a - 1], ids[b - 1]
                start, count = groups(bucket)
                blobs = [pack([first[x : x + m], second[x : x + m], n[x : x + m]]) for x, m in zip(start, count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(start), pa.string()), pa.array(bucket[start].astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(blobs, pa.binary())], ["shard", "bucket", "n", "blob"]
                )

    return apply


FREQUENT = "a long, b long, n long, shard string, bucket int, mask binary"


def _frequent_pairs(support: int):
    """Of one bucket, the pairs of enough count over all shards; and for each shard a bit for each of its pairs there, set if frequent."""

    def apply(table: pa.Table) -> pa.Table:
        parts = [unpack(b, n, [np.int64] * 3) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist())]
        first, second, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((second, first))
        new = np.ones(len(order), bool)
        new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        at, start = np.cumsum(new) - 1, np.flatnonzero(new)
        total = np.bincount(at, n[order]).astype(np.int64)
        often, f, m = np.empty(len(order), bool), int((total >= support).sum()), table.num_rows
        often[order] = (total >= support)[at]
        ends = np.cumsum([0, *(len(p[0]) for p in parts)])
        masks = [np.packbits(often[x:y]).tobytes() for x, y in zip(ends, ends[1:])]
        some = order[start[total >= support]]
        column = lambda x: pa.array(x.tolist() + [None] * m, pa.int64())
        back = [pa.array([None] * f + table.column(c).to_pylist(), t) for c, t in (("shard", pa.string()), ("bucket", pa.int32()))]
        return pa.table([column(first[some]), column(second[some]), column(total[total >= support]), *back, pa.array([None] * f + masks, pa.binary())], ["a", "b", "n", "shard", "bucket", "mask"])

    return apply


def _longer(longest: int, buckets: int):
    """Phrases of three words and more of each shard, along its frequent pairs, with their counts, packed by bucket."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = batch.column("masks")
            for k, (_, line, ids) in enumerate(_lines(batch)):
                bucket, a, b, _ = _shard_pairs(line, ids, buckets)
                size = {int(bucket[x]): int(m) for x, m in zip(*groups(bucket))}
                often = [np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=size[r["bucket"]]) for r in sorted(masks[k].as_py(), key=lambda r: r["bucket"])]
                often = np.concatenate(often).astype(bool)
                found = list(longer_phrases(line, len(ids), np.sort((a * (len(ids) + 1) + b)[often]), longest))
                if not found:
                    continue
                phrases, count = np.append(0, ids)[np.concatenate([p for p, _ in found])], np.concatenate([c for _, c in found])
                with np.errstate(over="ignore"):
                    h = mixed((phrases.view(np.uint64) * seeds(longest, 13)).sum(1))
                bucket = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, phrases, count = bucket[order], phrases[order], count[order]
                start, n = groups(bucket)
                blobs = [pack([*phrases[x : x + m].T, count[x : x + m]]) for x, m in zip(start, n)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[start].astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "n", "blob"])

    return apply


def _frequent_phrases(longest: int, support: int):
    """Of one bucket, the phrases of enough count over all shards."""

    def apply(table: pa.Table) -> pa.Table:
        *ids, n = gathered(table, [np.int64] * (longest + 1))
        order = np.lexsort(ids[::-1])
        rows = np.column_stack(ids)[order]
        new = np.append(True, (rows[1:] != rows[:-1]).any(1))
        total = np.bincount(np.cumsum(new) - 1, n[order]).astype(np.int64)
        rows, total = rows[new][total >= support], total[total >= support]
        ends = np.append(0, np.cumsum((rows > 0).sum(1))).astype(np.int32)
        return pa.table({"phrase": pa.ListArray.from_arrays(pa.array(ends), pa.array(rows[rows > 0])), "a": pa.array(total)})

    return apply


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of the frequent words (lang, word, word_id, a), of all phrases up to `longest` words of count `support` or more
    (phrase: array of word ids; a: occurrences), and of all word occurrences (lang, n).

    Texts are encoded once into shards of SHARD_WORDS words: a line of numbers with gaps between pieces, and a vocabulary.
    Words, and then pairs of frequent words, counted by bitmaps in each shard, add up by bucket over all shards, and each
    shard gets back which of its own are frequent. Longer phrases are mined in each shard depth first along frequent pairs (a phrase can't be frequent
    otherwise) and added up. So nothing is broadcast, and a task holds one shard or one bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.coalesce(F.sum(text_bytes(F.col("text"))), F.lit(0))).first()[0]
    made = written(rows.mapInArrow(_encode(buckets_for(size / 40)), SHARDS), "phrases-shards")
    totals = written(made.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    found = made.where("bucket is not null").select("shard", "bucket", "n", "blob", "names").groupBy("bucket").applyInArrow(_frequent_words(support), WORDS)
    found = written(found, "phrases-words")
    words = found.where("word_id is not null").select("lang", "word", "word_id", "a")
    known = found.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("bucket", "codes")).alias("words"))  # a shard's own words
    lines = written(made.where("line is not null").select("shard", "positions", "line").hint("merge").join(known, "shard"), "phrases-lines")
    discard(made)
    release(spark)
    buckets = buckets_for(size / 8)
    pairs = written(lines.mapInArrow(_pairs(buckets), PAIRS).groupBy("bucket").applyInArrow(_frequent_pairs(support), FREQUENT), "phrases-pairs")
    release(spark)
    own = pairs.where("shard is not null").groupBy("shard").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))  # a shard's own pairs
    more = lines.hint("merge").join(own, "shard").mapInArrow(_longer(longest, buckets), PACKED)
    more = more.groupBy("bucket").applyInArrow(_frequent_phrases(longest, support), "phrase array<long>, a long")
    two = pairs.where("shard is null").select(F.array("a", "b").alias("phrase"), F.col("n").alias("a"))
    one = words.select(F.array("word_id").alias("phrase"), "a")
    phrases = written(one.unionByName(two).unionByName(more), "phrases-counts")
    discard(lines, pairs)
    release(spark)
    return words, phrases, totals


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, top: int = TOP
) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each lang's `top` phrases by score, a, and phrase.

    a, l and r are the occurrences of a phrase and of the two sides of its lowest-scoring cut (of equals the first), n all words of the lang;
    score is floor(1000 a n / (l r)), exact for counts below 10^17. A phrase that occurs only inside one longer candidate
    isn't returned; it is enough to look at candidates longer by one word, as counts fall with length.

    Null and empty texts have no words; a null lang is `und`, like that text. Repeated rows count as often as they come, a long text
    is one whole, and words keep their bytes but for A-Z. Extra columns are ignored, whatever their names. An empty table gives an empty result.
    """
    words, phrases, totals = phrase_counts(docs, text_col, lang_col, longest, support)
    named = written(spread_join(words, totals.withColumn("share", F.col("n")), ["lang"], "share"), "phrases-named")
    some = phrases.where(F.size("phrase") > 1)
    size = F.size("phrase")
    cuts = some.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", 1, F.col("k")), "right": F.slice("phrase", F.col("k") + 1, size - F.col("k")), "word_id": F.col("phrase")[0]})
    side = lambda key, count: phrases.select(F.col("phrase").alias(key), F.col("a").alias(count), F.col("a").alias("often"))
    cuts = spread_join(cuts, side("left", "l"), ["left"], "often").drop("left")
    cuts = spread_join(cuts, side("right", "r"), ["right"], "often").drop("right")
    cuts = spread_join(cuts, named.select("word_id", "lang", "n", F.col("a").alias("often")), ["word_id"], "often").drop("word_id")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    best = cuts.groupBy("phrase", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = some.where(size > 2).select("a", F.explode(F.array(F.slice("phrase", 1, size - 1), F.slice("phrase", 2, size - 1))).alias("phrase"))
    inside = inside.groupBy("phrase").agg(F.max("a").alias("most"))
    best = best.hint("merge").join(inside, "phrase", "left").where("most is null or most < a")
    best = written(best.select("phrase", "a", "lang", "n", "cut.*"), "phrases-scored")
    spelled_out = best.select("phrase", F.posexplode("phrase").alias("at", "word_id"))
    spelled_out = spread_join(spelled_out, named.select("word_id", "word", F.col("a").alias("often")), ["word_id"], "often")
    spelled_out = spelled_out.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("words"))
    found = best.hint("merge").join(spelled_out, "phrase").withColumn("phrase", F.concat_ws(" ", "words.word"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, ws[i:i + k - 1] AS g FROM w, unnest(range(1, 6)) AS t(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g HAVING count(*) >= 100),
c AS (
  SELECT f.lang, f.g, f.k, f.a, l.a AS l, r.a AS r, n.n, h, CAST(CAST(1000 AS HUGEINT) * f.a * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM f JOIN n ON n.lang = f.lang, unnest(range(1, f.k)) AS t(h) JOIN f l ON l.lang = f.lang AND l.g = f.g[1:h] JOIN f r ON r.lang = f.lang AND r.g = f.g[h + 1:f.k]
  WHERE f.k > 1
), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, h) = 1),
s AS (
  SELECT f.lang, f.g[i:i + m - 1] AS g, max(f.a) AS a FROM f, unnest(range(2, f.k)) AS t(m), unnest(range(1, f.k - m + 2)) AS u(i) GROUP BY ALL
), o AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, CAST(b.n AS BIGINT) AS n, b.score FROM b LEFT JOIN s ON s.lang = b.lang AND s.g = b.g
  WHERE s.a IS NULL OR 100 * s.a < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""
