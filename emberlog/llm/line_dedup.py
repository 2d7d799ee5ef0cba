"""Line dedup by pairwise alignment of overlapping documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import discard, read, small_batches, written
from emberlog.operators.skew import spread_join

#: A shared line says that two documents overlap if it has so many characters at least; a shorter one by a shared run.
MIN_CHARS = 20
BLANK = 0
#: A line (or run) is rare with so many holders; only rare ones propose pairs at first.
RARE = 8
#: Each round of further holders tries so many times as many as all before it.
MORE = 16
#: Pairs with one earlier document, and holders of one key, that a task gets.
TOGETHER = 1000


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both places; pairs come in order of the first."""
    tops, back, best = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b), best.append(k)
        else:
            tops[at], best[at] = b, k
        back.append(best[at - 1] if at else -1)
    out, k = [], best[-1] if best else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


#: Bits kept at once to trace a longest common subsequence; a larger one is halved first.
LCS_BITS = 1 << 28


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a: bit k is clear where b[:k + 1] has a longer common subsequence with a's lines so far than b[:k]."""
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    every = row = (1 << len(b)) - 1
    for x in a:
        both = row & places.get(x, 0)
        row = ((row + both) | (row - both)) & every
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of a and b[:0], b[:1], .."""
    row = 0
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in no order, by bit-parallel rows; memory is bounded by halving a."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        if len(x) > 1 and len(x) * len(y) > LCS_BITS:
            half = len(x) // 2
            at = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(a0, a0 + half, b0, b0 + at), (a0 + half, a1, b0 + at, b1)]
            continue
        rows = [(1 << len(y)) - 1, *_rows(x, y)]
        i, j = len(x), len(y)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            elif rows[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
            else:
                i -= 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of equal lines by patience diff: common heads and tails, then lines unique on both sides as anchors,
    and so on between the anchors; a longest common subsequence where there are none. Without recursion, so long documents are fine."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[k]: k for k in range(b0, b1) if in_b[b[k]] == 1}
        anchors = increasing([(k, at[a[k]]) for k in range(a0, a1) if in_a[a[k]] == 1 and a[k] in at])
        for x, y in anchors:
            todo.append((a0, x, b0, y))
            a0, b0 = x, y  # the anchor opens the next part, as its head
        if anchors:
            todo.append((a0, a1, b0, b1))
            continue
        xs, ys = ([k for k in range(lo, hi) if side[k] != BLANK and side[k] in other] for side, lo, hi, other in ((a, a0, a1, in_b), (b, b0, b1, in_a)))
        out += [(xs[i], ys[j]) for i, j in common([a[k] for k in xs], [b[k] for k in ys])]
    return sorted(out)


def aligned_blocks(earlier: list[int], later: list[int]) -> list[int]:
    """Places in the later document of the lines to delete; blank lines take no part."""
    a, places = [x for x in earlier if x != BLANK], [k for k, x in enumerate(later) if x != BLANK]
    return [places[y] for _, y in patience(a, [later[k] for k in places])]


def _shown() -> tuple[Column, Column]:
    """Of a row's lines: keys that show an overlap, with the places that they stand for; and the other lines likewise."""
    marked = F.transform(F.arrays_zip("lines", "long"), lambda x, k: F.struct(x["lines"].alias("line"), x["long"].alias("long"), k.alias("at")))
    lines = F.filter(marked, lambda x: x["line"] != BLANK)
    one = lambda x: F.struct(x["line"].alias("key"), F.array(x["at"]).alias("at"))
    two = lambda x, y: F.struct(F.xxhash64(x["line"], y["line"]).alias("key"), F.array(x["at"], y["at"]).alias("at"))
    sole = F.size(F.array_distinct(F.transform(lines, lambda x: x["line"]))) == 1
    n = F.greatest(F.size(lines) - 1, F.lit(0))
    runs = F.zip_with(F.slice(lines, F.lit(1), n), F.slice(lines, F.lit(2), n), two)
    short = F.transform(F.filter(lines, lambda x: ~x["long"]), one)
    none = F.filter(short, lambda x: F.lit(False))
    return F.concat(F.transform(F.filter(lines, lambda x: x["long"]), one), runs, F.when(sole, short).otherwise(none)), F.when(sole, none).otherwise(short)


def _aligned(pairs: DataFrame, later: DataFrame, earlier: DataFrame) -> DataFrame:
    """The places to cut of each pair's later document, where there are any.

    The earlier document's lines are copied for each TOGETHER of its pairs, so a document that very many others meet is
    dealt to many tasks; the later document's lines are shuffled once and not once a pair.
    """
    many = pairs.groupBy("first").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / TOGETHER))
    many = written(many, "line-many")
    dealt = spread_join(pairs, many, ["first"], "n").withColumn("salt", F.pmod(F.xxhash64("id", "mark"), "copies")).drop("copies")
    lines = earlier.join(many.hint("merge"), "first").select("first", F.col("lines").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    sides = dealt.hint("merge").join(lines, ["first", "salt"]).select("id", "mark", "a")
    sides = sides.hint("merge").join(later.select("id", "mark", F.col("lines").alias("b")), ["id", "mark"])
    schema = T.StructType([sides.schema["id"], sides.schema["mark"], T.StructField("cut", T.ArrayType(T.IntegerType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [aligned_blocks(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(cut, pa.list_(pa.int32()))], ["id", "mark", "cut"])

    found = written(sides.mapInArrow(align, schema).where(F.size("cut") > 0), "line-cut")
    discard(many)
    return found


def _left(shown: DataFrame, cuts: DataFrame) -> DataFrame:
    """Of keys and their places, those whose place isn't cut."""
    return shown.join(cuts.select("id", "mark", F.explode("cut").alias("at")).hint("merge"), ["id", "mark", "at"], "left_anti")


def _orders(earlier: DataFrame, holders: DataFrame, shared: DataFrame) -> DataFrame:
    """first, order: of the holders' documents, a hash of their lines in order, all runs of lines that no other document has being alike.

    Documents of one order align alike with any other document, as such lines only part its own.
    """
    lines = earlier.hint("merge").join(holders.select("first").distinct(), "first", "left_semi")
    lines = lines.select("first", F.posexplode(F.filter("lines", lambda x: x != BLANK)).alias("at", "key"))
    lines = spread_join(lines, shared.select("key", "n", F.col("n").alias("known")), ["key"], "n", "left")
    said = F.when(F.col("known").isNull(), F.lit(BLANK)).otherwise(F.col("key"))
    found = lines.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("at", said.alias("line")))).alias("lines"))
    said = F.transform("lines", lambda x: x["line"])
    found = found.select("first", said.alias("lines"))
    kept = F.filter("lines", lambda x, k: (x != BLANK) | (k == 0) | (F.get("lines", k - 1) != BLANK))
    return found.select("first", F.xxhash64(kept).alias("order"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with `text` cut and columns n_lines and n_removed appended (replacing ones of these names).

    Lines are told apart by '\\n' and compared without blanks at their ends. Documents overlap that share a line of at least
    min_chars characters, or two lines of any length in a row (blank lines aside), or a line of any length that is all that
    the later one has. A pair is aligned by patience diff over line hashes, and the aligned lines that aren't blank go
    from the later document; texts of the input are aligned, not what is left of them. Blank lines stay, and aren't aligned.

    Of the keys that show an overlap (such lines and runs), rare ones propose pairs first: a later document meets the
    first holder (the smallest id) of each rare key of its own. Keys that still have a line that stays then bring the first
    holder whatever their number of holders, and then the other earlier holders (a shorter line those that overlap
    its document), one for each order of shared lines, in rounds of more and more of them, until the line goes or has met all. So a
    line stays only if no earlier document that overlaps its own aligns it, and the order of the rounds only decides the work. Documents of equal
    lines are one holder, and all but the first are cut whole. Which of several equally long alignments is
    taken depends on the two documents' lines alone.

    Null text stays null (no lines); an empty text has one blank line. Rows with null ids are neither first holders nor
    cut. Of rows that share an id, the one with the smallest text hash stands for it as the earlier document, and none
    cuts another; repeated rows are cut alike. Rows keep their other columns. A document may end up with no text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_lines", "n_removed")
    text = F.col(text_col)
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), trimmed.alias("said"))
    hashes = F.transform("said", lambda x: F.when(x == "", F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x)))
    rows = rows.select("id", "mark", hashes.alias("lines"), F.transform("said", lambda x: F.length(x) >= min_chars).alias("long"))
    rows = rows.repartition("id").groupBy("id", "mark").agg(F.first("lines").alias("lines"), F.first("long").alias("long"))
    rows = rows.withColumn("stands", F.col("mark") == F.min("mark").over(Window.partitionBy("id"))).withColumn("whole", F.xxhash64("lines"))
    rows = written(rows, "line-hashes")
    wholes = written(rows.where("stands").groupBy("whole").agg(F.min("id").alias("own"), F.count("*").alias("n")), "line-wholes")
    later = spread_join(rows, wholes, ["whole"], "n", "left").drop("whole")
    later = written(later.withColumn("copy", F.coalesce(F.col("own") < F.col("id"), F.lit(False))).withColumn("stands", F.col("stands") & ~F.col("copy")), "line-later")
    earlier = later.where("stands").select(F.col("id").alias("first"), "lines", "long")
    discard(rows, wholes)
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda k: F.get("lines", k) != BLANK)
    copies = later.where("copy").select("id", "mark", places.alias("cut"))
    every_row, later = later, later.where("not copy").select("id", "mark", "stands", "lines", "long")
    shown, rest = _shown()
    every = F.transform(F.concat(shown, rest), lambda x: x["key"])
    firsts = earlier.select("first", F.explode(every).alias("key")).groupBy("key").agg(F.min("first").alias("first"), F.count("*").alias("holders"))
    firsts = written(firsts.where("holders > 1").withColumn("n", F.col("holders")), "line-firsts")
    met = lambda keys: spread_join(later.select("id", "mark", "stands", F.explode(keys).alias("k")).select("id", "mark", "stands", "k.*"), firsts, ["key"], "n").where("first < id").withColumn("at", F.explode("at"))
    left, others = written(met(shown), "line-keys"), written(met(rest), "line-rest")
    # Who holds a shared key: its first holder, and the stands among the later ones.
    held = reduce(DataFrame.unionByName, [firsts.select("key", "first"), *[x.where("stands").select("key", F.col("id").alias("first")) for x in (left, others)]]).distinct()
    tables, cuts, pairs = [every_row, left, others], [], None
    keys, left, others = left, left.drop("stands"), others.drop("stands")
    for now in (f"holders <= {RARE}", f"holders > {RARE}"):
        fresh = left.where(now).select("id", "mark", "first").distinct()
        fresh = written(fresh if pairs is None else fresh.join(pairs.hint("merge"), ["id", "mark", "first"], "left_anti"), "line-pairs")
        cuts.append(_aligned(fresh, later, earlier))
        pairs = fresh if pairs is None else pairs.unionByName(fresh)
        left = written(_left(left, cuts[-1]), "line-left")
        tables += [fresh, left]
    # Lines that stay: those whose own key shows an overlap, and others of documents with any pair.
    done = reduce(DataFrame.unionByName, cuts)
    others = others.join(pairs.select("id", "mark").distinct().hint("merge"), ["id", "mark"], "left_semi")
    others = written(_left(others, done), "line-left")
    asked = keys.hint("merge").join(others.select("id", "mark").distinct(), ["id", "mark"], "left_semi").select("id", "mark", "key").distinct()
    asked = written(asked, "line-asked")
    wanted = reduce(DataFrame.unionByName, [x.select("key") for x in (left, asked, others)]).distinct().hint("merge").join(firsts, "key").select("key", "n", F.ceil(F.col("n") / TOGETHER).alias("parts"))
    wanted = written(wanted, "line-wanted")
    # Holders of one order of lines cut the same, so the first of them stands for all: lines that very many documents share in a few
    # orders, as page footers are, bring a few holders.
    holders = written(spread_join(held, wanted, ["key"], "n"), "line-held")
    orders = written(_orders(earlier, holders, firsts), "line-orders")
    holders_of = holders.hint("merge").join(orders, "first").groupBy("key", "order").agg(F.min("first").alias("first"), F.first("parts").alias("parts"))
    tables += [holders, orders]
    # The holders of a key are numbered in parts, so no task numbers all of a common key's.
    ranked = holders_of.withColumn("part", F.pmod(F.xxhash64("first"), "parts"))
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("first"))
    ranked = written(ranked.select("key", "first", ((number - 1) * F.col("parts") + F.col("part") + 1).alias("rank")), "line-holders")
    tables += [ranked, asked, others, wanted, firsts]
    kept = ("id", "mark", "key", "at")
    left = left.select(*kept, F.lit(True).alias("shows")).unionByName(others.select(*kept, F.lit(False).alias("shows")))
    lo, top = 0, ranked.agg(F.max("rank")).first()[0] or 0
    while lo < top and not left.isEmpty():
        hi = lo * (MORE + 1) + MORE
        next_ones = ranked.where(f"rank > {lo} and rank <= {hi}").select("key", "first")
        by_key = left.where("shows").join(next_ones, "key").where("first < id").select("id", "mark", "first")
        others = left.where("not shows")
        now = asked.join(others.select("id", "mark").distinct(), ["id", "mark"], "left_semi").join(next_ones, "key").where("first < id").select("id", "mark", "first").distinct()
        # Only partners that hold a line that stays can cut more.
        now = now.join(others.select("id", "mark", "key"), ["id", "mark"]).join(ranked, ["key", "first"], "left_semi").select("id", "mark", "first")
        now = written(now.unionByName(by_key).distinct().join(pairs, ["id", "mark", "first"], "left_anti"), "line-pairs")
        tables.append(now)
        if not now.isEmpty():
            cuts.append(_aligned(now, later, earlier))
            left = written(_left(left, cuts[-1]), "line-left")
            tables.append(left)
            pairs = pairs.unionByName(now)
        lo = hi
    found = cuts
    cuts = reduce(DataFrame.unionByName, found).select("id", "mark", F.explode("cut").alias("at")).groupBy("id", "mark").agg(F.collect_set("at").alias("cut"))
    cuts = written(cuts.unionByName(copies), "line-cuts")
    discard(*tables, *found)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"), own.alias("row")).hint("merge").join(cuts, ["id", "mark"], "left")
    text = F.col("row")[text_col]
    out = out.select("row", F.sort_array("cut").alias("cut"), F.split(text, "\n").alias("parts"))
    # What stays: the runs between one cut place and the next.
    before, after = F.concat(F.array(F.lit(-1)), "cut"), F.concat("cut", F.array(F.size("parts")))
    kept = F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice("parts", a + 2, b - a - 1))), "\n")
    return out.select(
        *[(F.when(F.col("cut").isNull(), text).otherwise(kept) if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
