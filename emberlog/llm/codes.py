"""Vector code compression: product codes of integer vectors, whose nearest entries are found by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, read, small_batches, written
from emberlog.operators.skew import spread_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one entry that are searched together.
SLAB = 128
#: Integers of this size and above have no 64-bit sums of products; vectors that hold one are dropped.
WIDEST = 1 << 60
#: Components travel as high * 2^LOW_BITS + low, so that sums over very many rows stay within 64 bits.
LOW_BITS = 20


class Book:
    """One part position's entries, and for each entry all entries by distance from it, ties by index."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, dtype=np.int64).reshape(len(entries), -1)
        self.largest = int(np.abs(self.entries).max(initial=0))
        apart = self.squared(self.entries, self.entries)
        index = np.arange(len(entries))
        self.near = np.array([sorted(index, key=lambda j: (row[j], j)) for row in apart], dtype=np.int64).reshape(len(entries), -1)
        self.apart = [row[near] for row, near in zip(apart, self.near)]

    def squared(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Exact squared distances, as floats as long as all sums fit 53 bits, else as Python integers."""
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        if x.shape[1] * (2 * largest) ** 2 < 1 << 53:
            x, c = x.astype(np.float64), entries.astype(np.float64)
            return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        x, c = x.astype(object), entries.astype(object)
        return np.array([[((a - b) ** 2).sum() for b in c] for a in x], dtype=object).reshape(len(x), len(c))

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row, the lowest of equals, and its squared distance; start: some entry of each row.

        An entry as near to x as its start s, at distance u, lies within 2u of s. So only the head of s's neighbour list
        is scanned, up to squared distance 4u^2, which includes all ties.
        """
        found, error = start.copy(), np.zeros(len(x), object)
        order = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[order], np.arange(len(self.entries) + 1))
        for s, near in enumerate(self.near):
            rows = order[cuts[s] : cuts[s + 1]]
            if not len(rows):
                continue
            own = self.squared(x[rows], self.entries[s : s + 1])[:, 0]
            by = np.argsort(own, kind="stable")
            rows, own = rows[by], own[by]
            reach = np.searchsorted(self.apart[s], 4 * own, "right")
            for lo in range(0, len(rows), SLAB):
                some, most = rows[lo : lo + SLAB], int(reach[lo : lo + SLAB][-1])
                inside = np.sort(near[:most])
                place = np.argsort(near[:most])
                d = self.squared(x[some], self.entries[inside])
                d[place >= reach[lo : lo + SLAB, None]] = np.inf
                at = d.argmin(1)
                found[some], error[some] = inside[at], d[np.arange(len(some)), at]
        return found, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _codes(codes: np.ndarray) -> pa.Array:
    n, parts = codes.shape
    data = np.ascontiguousarray(codes.astype(np.uint8))
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * parts + 1, parts, dtype=np.int32)), pa.py_buffer(data)])


def _assigned(batch: pa.RecordBatch, books: list[Book], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Parts, codes and errors of a batch; a row without a code starts at entry 0."""
    x = _matrix(batch.column("v"), width * len(books))
    parts = [x[:, k * width : (k + 1) * width] for k in range(len(books))]
    before = batch.column("code")
    blank = bytes(len(books))
    start = np.frombuffer(b"".join(blank if c is None else c for c in before.to_pylist()), np.uint8).reshape(-1, len(books)).astype(np.int64)
    done = [book.nearest(part, start[:, k]) for k, (book, part) in enumerate(zip(books, parts))]
    return parts, np.column_stack([code for code, _ in done]), sum((error for _, error in done), np.zeros(len(x), object))


def _round(books: list[Book], width: int) -> Callable:
    """Rows with their new codes; at a task's end, a row for each entry in use: count and sums of its parts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), ENTRIES), np.int64)
        sums = np.zeros((2, len(books), ENTRIES, width), np.int64)
        names, kinds = [], []
        for batch in batches:
            parts, codes, _ = _assigned(batch, books, width)
            for k, part in enumerate(parts):
                count[k] += np.bincount(codes[:, k], minlength=ENTRIES)
                np.add.at(sums[0, k], codes[:, k], part >> LOW_BITS)
                np.add.at(sums[1, k], codes[:, k], part & ((1 << LOW_BITS) - 1))
            kept = [batch.column(c) for c in ("id", "label", "v")]
            names, kinds = ["id", "label", "v"], [c.type for c in kept]
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, _codes(codes), *none], [*names, "code", "part", "entry", "n", "high", "low"])
        part, entry = np.nonzero(count)
        if len(part):
            none = [pa.nulls(len(part), t) for t in (*kinds, pa.binary())]
            own = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry])]
            lists = [pa.array(list(s[part, entry]), pa.list_(pa.int64())) for s in sums]
            yield pa.RecordBatch.from_arrays([*none, *own, *lists], [*names, "code", "part", "entry", "n", "high", "low"])

    return apply


def _last(books: list[Book], width: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, errors = _assigned(batch, books, width)
            errors = [int(e) if e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), _codes(codes), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    return apply


def _moved(book: Book, sums: dict[int, tuple[int, dict[int, int]]]) -> Book:
    """Entries in use go to the componentwise floor of the mean of their parts."""
    entries = book.entries.tolist()
    for entry, (n, total) in sums.items():
        entries[entry] = [total[k] // n for k in range(book.entries.shape[1])]
    return Book(entries)


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[Book]]:
    """id, label, code (binary: an entry's index for each part), error for every kept row; and the final codebooks.

    A component x is the integer floor(1024 x). Null vectors and vectors that hold a null or non-finite component are dropped, and so are ones
    of another length than the first kept vector (by id, nulls last, then by vector), of a length that isn't a positive
    multiple of `parts`, or with an integer of 2^60 or more. A codebook starts as its part of the first `entries` (256 at
    most) vectors; with fewer vectors it has fewer entries. Ids may repeat and be null; each row is coded by itself. An
    error beyond 64 bits is null. Labels are carried only. Extra columns are ignored. An empty table gives an empty
    result and no codebooks.

    Codebooks have a fixed size and travel with the tasks. Every round is one pass: rows are written with their codes, which
    the next round's search starts from, and each task adds the sums of its parts by entry, which Spark adds up.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"entries must lie between 1 and {ENTRIES}")
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("x"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= WIDEST / SCALE))
    rows = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0) & ~bad).withColumn("v", F.transform("x", lambda x: F.floor(x * SCALE))).drop("x")
    table = written(rows.withColumn("code", F.lit(None).cast("binary")), "codes-vectors")
    by = [F.asc_nulls_last("id"), F.asc("v")]
    first = table.orderBy(*by).select(F.size("v")).first()
    length = first[0] if first else parts
    width = length // parts
    kept = table.where(F.size("v") == length)
    seeds = [r.v for r in kept.orderBy(*by).limit(entries).collect()]
    books = [Book([s[k * width : (k + 1) * width] for s in seeds]) for k in range(parts)] if seeds else []
    kinds = dict(kept.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, "
    if not books:
        return kept.select("id", "label", "code", F.lit(None).cast("long").alias("error")), books
    for _ in range(rounds):
        step = written(kept.mapInArrow(_round(books, width), schema + "v array<long>, code binary, part int, entry int, n long, high array<long>, low array<long>"), "codes-round")
        discard(table)
        table, kept = step, step.where("part is null").select("id", "label", "v", "code")
        sums = step.where("part is not null").select("part", "entry", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
        found: list[dict] = [{} for _ in books]
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).collect():  # one row a component of the codebooks
            found[r.part].setdefault(r.entry, (r.n, {}))[1][r.at] = (r.high << LOW_BITS) + r.low
        books = [_moved(book, s) for book, s in zip(books, found)]
    return kept.mapInArrow(_last(books, width), schema + "code binary, error long"), books


def digest(books: list[Book]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.entries.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error: the sum of error over rows of equal label, nulls together; null where it or an error passes 64 bits."""
    rows = written(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes-final")
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = rows.groupBy("key").agg(total.alias("total"), F.count("*").alias("n"))
    sums = sums.select("key", "n", F.when(F.col("total") < F.lit(str(1 << 63)).cast("decimal(38,0)"), F.col("total")).cast("long").alias("label_error"))
    return spread_join(rows, sums, ["key"], "n", how="left").drop("key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(read(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds as common table expressions; `x` is a part's list of integers."""
    distance = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS (
  SELECT p.vec_id, p.label, p.part, any_value(p.x) AS x, min({distance}) AS d, arg_min(b.entry, {distance} * {ENTRIES} + b.entry) AS entry
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY p.vec_id, p.label, p.part)""")
        if r < ROUNDS:
            steps.append(f"""s{r} AS (
  SELECT part, entry, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY part, entry, i
), m{r} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY part, entry
), b{r + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM v, unnest(range({PARTS})) AS t(part)
), b0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES}
), {", ".join(steps)},
h AS (SELECT sha256(string_agg(CAST(x[i] AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM b{ROUNDS}, unnest(range(1, len(x) + 1)) AS t(i)),
c AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c, h
"""


OP11_SQL = _sql()
