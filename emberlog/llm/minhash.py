"""MinHash near-dedup by a multi-index Hamming join: groups of documents whose four-word shingle sets link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import discard, read, release, small_batches, text_bytes, written
from emberlog.llm.components import components
from emberlog.llm.words import Words, distinct, hashed, mix, ngrams, seeds
from emberlog.operators.skew import spread_join

WORDS = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A signature is SYMBOLS minimal hashes of 16 bits each, in CHUNKS chunks. Two signatures that differ in DISTANCE symbols or
#: fewer have a chunk with ERRORS errors or fewer. Two sets of similarity 0.8 share no such chunk with probability 1.3e-12.
SYMBOLS, CHUNKS, ERRORS = 64, 16, 1
DISTANCE = (ERRORS + 1) * CHUNKS - 1
#: Bits of each symbol by which distances are taken; symbols that differ in them differ, so no distance is too large.
PLANES = 4
#: Documents and bytes of text of one block of a family; small families share a group of about BLOCK documents or CELL_BYTES.
BLOCK, BLOCK_BYTES, CELL_BYTES = 256, 8 << 20, 4 << 20

_FACTORS = seeds(SYMBOLS, 1301)


def shingle_sets(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; with fewer words, the whole sequence as one."""
    h, at = ngrams(words, WORDS, 13)
    cut = np.searchsorted(words.doc[at], np.arange(words.lo, words.hi + 1))
    bounds = words.bounds()
    out = []
    for k in range(words.hi - words.lo):
        own = words.hash[bounds[k] : bounds[k + 1]]
        if cut[k + 1] > cut[k]:
            out.append(distinct(h[cut[k] : cut[k + 1]]))
        elif len(own):
            with np.errstate(over="ignore"):
                out.append(mix((own * seeds(WORDS, 17)[: len(own)]).sum(keepdims=True) + np.uint64(len(own))))
        else:
            out.append(own)
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SYMBOLS 16-bit symbols of each of some non-empty sets."""
    if not sets:
        return np.zeros((0, SYMBOLS), np.uint64)
    every, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_FACTORS):
            out[:, k] = np.minimum.reduceat(every * factor, at)
    return mix(out) & np.uint64(0xFFFF)


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of each signature: of every chunk, for each place that may hold an error, the symbols of the other places.

    The number of the chunk and of the place, and three symbols, fill 54 bits, so equal keys are equal symbols.
    """
    size = SYMBOLS // CHUNKS
    chunks = symbols.reshape(-1, CHUNKS, size)
    out = np.empty(chunks.shape, np.uint64)
    for place in range(size):
        key = np.broadcast_to((np.arange(CHUNKS, dtype=np.uint64) * np.uint64(size) + np.uint64(place)), chunks.shape[:2])
        for other in range(size):
            if other != place:
                key = (key << np.uint64(16)) | chunks[:, :, other]
        out[:, :, place] = key
    return out.reshape(len(chunks), SYMBOLS).view(np.int64)


def bit_planes(symbols: np.ndarray) -> np.ndarray:
    """PLANES 64-bit integers of each signature, one for each of the lowest bits of its symbols."""
    planes = [np.packbits(((symbols >> np.uint64(b)) & np.uint64(1)).astype(bool), axis=1, bitorder="little") for b in range(PLANES)]
    return np.stack([np.ascontiguousarray(p).view(np.uint64)[:, 0] for p in planes], axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n", "d1", "d2", "keys"]
    for batch in batches:
        for words in hashed(batch.column("text"), lower=True):
            sets = shingle_sets(words)
            n = np.array([len(s) for s in sets])
            some = [s for s in sets if len(s)]
            symbols = signatures(some)
            with np.errstate(over="ignore"):
                d1 = np.array([(s * seeds(1, 77)[0]).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                d2 = np.array([mix(s * seeds(1, 78)[0]).sum() if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            ids = batch.column("id").slice(words.lo, words.hi - words.lo)
            at = pa.array(np.append(0, np.cumsum((n > 0) * SYMBOLS)).astype(np.int32))
            keys = pa.ListArray.from_arrays(at, pa.array(chunk_keys(symbols).ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(d1), pa.array(d2), keys], names)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two whole sets link."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def near_enough(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which signatures lie within DISTANCE of one, of sets whose sizes let them link, and the distances."""
    d = np.bitwise_count(np.bitwise_or.reduce(others ^ one, axis=1))
    return (d <= DISTANCE) & (100 * np.minimum(sizes, size) >= PERCENT * np.maximum(sizes, size)), d


def spanning(sets: list[np.ndarray], planes: np.ndarray, label: np.ndarray, asked: np.ndarray, rank: np.ndarray) -> list[tuple[int, int]]:
    """Links between asked documents and all others that join differently labelled ones; label is changed in place.

    Candidates come by distance. A pair under one label by now is connected already. Of two asked documents, the one of
    lower rank asks the other.
    """
    sizes, found = np.array([len(s) for s in sets]), []
    order = np.full(len(sets), np.iinfo(np.int64).max)
    order[asked] = rank[asked]
    for x in asked[np.argsort(rank[asked], kind="stable")]:
        fits, d = near_enough(planes[x], planes, sizes[x], sizes)
        some = np.flatnonzero(fits & (label != label[x]) & (order > order[x]))
        for y in some[np.argsort(d[some], kind="stable")]:
            if label[y] != label[x] and linked(sets[x], sets[y]):
                label[label == label[y]] = label[x]
                found.append((int(x), int(y)))
    return found


def _columns(table: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray]:
    """The rows with words, their sets and bit planes."""
    sets = [s for words in hashed(table.column("text"), lower=True) for s in shingle_sets(words)]
    table = table.filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))
    sets = [s for s in sets if len(s)]
    return table, sets, bit_planes(signatures(sets))


def _runs(table: pa.Table, names: list[str]) -> Iterator[pa.Table]:
    """The rows of each combination of values."""
    table = table.sort_by([(c, "ascending") for c in names])
    if not table.num_rows:
        return
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in names:
        column = table.column(c).to_pylist()
        new[1:] |= np.array([a != b for a, b in zip(column, column[1:])], bool)
    cut = np.flatnonzero(new)
    for lo, hi in zip(cut, np.append(cut[1:], table.num_rows)):
        yield table.slice(lo, hi - lo)


def _found(table: pa.Table, links: list[tuple[int, int]], alone: np.ndarray) -> pa.Table:
    """Rows (a, b) of links, and (a, null) of documents that are not connected with their family's pivot."""
    ids, pivots = table.column("id").combine_chunks(), table.column("pivot").combine_chunks()
    at = pa.array([i for i, _ in links] + alone.tolist(), pa.int64())
    b = pa.array([j for _, j in links] + [None] * len(alone), pa.int64())
    return pa.table({"pivot": pivots.take(at), "a": ids.take(at), "b": ids.take(b)})


def _within(table: pa.Table) -> pa.Table:
    """Whole small families, or blocks of large ones with their pivot: links that span each one's components."""
    out = []
    for part in _runs(table, ["pivot", "block"]):
        if part.num_rows < 2:
            continue
        part, sets, planes = _columns(part)
        pivot = np.array(part.column("hub").to_pylist(), bool)
        label, rank = np.arange(len(sets)), np.arange(len(sets))
        links = spanning(sets, planes, label, np.flatnonzero(pivot), rank)
        rest = np.flatnonzero(label != label[pivot.argmax()])
        links += spanning(sets, planes, label, rest, rank)
        alone = np.flatnonzero((label != label[pivot.argmax()]) & (part.column("blocks").to_numpy() > 1))
        out.append(_found(part, links, alone))
    return pa.concat_tables(out) if out else _found(table.slice(0, 0), [], np.zeros(0, np.int64))


def _between(table: pa.Table) -> pa.Table:
    """Documents of one block that aren't connected with the pivot, against all documents of another block."""
    out = []
    for part in _runs(table, ["pivot", "i", "j"]):
        part, sets, planes = _columns(part)
        own, i, j = (part.column(c).to_numpy() for c in ("own", "i", "j"))
        alone = np.array(part.column("alone").to_pylist(), bool)
        asked = np.flatnonzero(alone & (own == i))
        label = np.where(alone, np.arange(len(sets)), -1)
        keep = np.flatnonzero((own == i) & alone | (own == j) & ~(alone & (j < i)))  # two such documents meet once
        links = spanning([sets[k] for k in keep], planes[keep], label[keep], np.flatnonzero(np.isin(keep, asked)), np.zeros(len(keep), np.int64))
        out.append(_found(part, [(int(keep[x]), int(keep[y])) for x, y in links], np.zeros(0, np.int64)))
    return pa.concat_tables(out) if out else _found(table.slice(0, 0), [], np.zeros(0, np.int64))


def family_links(family: DataFrame, docs: DataFrame, kind: str) -> DataFrame:
    """Links (a, b) that span the components of all families (pivot, id).

    A family is cut into blocks of BLOCK documents or BLOCK_BYTES of text, each with the pivot. Documents connected with the
    pivot are one component, whatever their blocks, so only the others meet the documents of other blocks.
    """
    lengths = docs.groupBy("id").agg(F.sum(text_bytes(F.col("text"))).alias("bytes"))
    sizes = family.hint("merge").join(lengths, "id").groupBy("pivot").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"))
    sizes = written(sizes.where("m > 1").withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))), "minhash-blocks")
    total = sizes.where("blocks = 1").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    cells = int(max(total[0] // CELL_BYTES, total[1] // BLOCK) + 1)
    placed = spread_join(family, sizes.drop("bytes"), ["pivot"], "m").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = written(placed.select("pivot", "id", "blocks", "own", (F.col("id") == F.col("pivot")).alias("hub")), "minhash-family")
    wanted = placed.select("id").distinct()
    # Nothing here has a size bound, so no side is broadcast.
    texts = docs.join(wanted.hint("merge"), "id", "left_semi").select("id", "text")
    texts = written(texts.withColumn("k", F.xxhash64("text")).dropDuplicates(["id", "k"]).drop("k"), "minhash-texts")
    rows = placed.withColumn("block", F.explode(F.when(F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))))
    cell = F.when(F.col("blocks") > 1, F.xxhash64("pivot", "block")).otherwise(F.pmod(F.xxhash64("pivot"), F.lit(cells)))
    schema = f"pivot {kind}, a {kind}, b {kind}"
    first = rows.hint("merge").join(texts, "id").withColumn("cell", cell).groupBy("cell").applyInArrow(_within, schema)
    first = written(first, "minhash-links")
    release(docs.sparkSession)
    alone = first.where("b is null").select("pivot", F.col("a").alias("id")).distinct()
    if alone.isEmpty():
        return first.select("a", "b")
    apart = placed.join(alone.withColumn("alone", F.lit(True)).hint("merge"), ["pivot", "id"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    apart = written(apart.join(alone.select("pivot").distinct().hint("merge"), "pivot", "left_semi"), "minhash-apart")
    asking = apart.where("alone").groupBy("pivot").agg(F.collect_set("own").alias("asking"), F.count("*").alias("m"))  # as many as blocks
    members = spread_join(apart, written(asking, "minhash-asking"), ["pivot"], "m")
    members = members.select("*", F.explode("asking").alias("i")).where("i <> own").withColumn("j", F.col("own")).drop("asking")
    others = F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own"))
    askers = apart.where("alone").withColumn("i", F.col("own")).select("*", F.explode(others).alias("j"))
    rows = members.unionByName(askers).hint("merge").join(texts, "id")
    more = written(rows.groupBy("pivot", "i", "j").applyInArrow(_between, schema), "minhash-links")
    release(docs.sparkSession)
    return first.where("b is not null").unionByName(more).select("a", "b")


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component (the smallest id reachable by links), kept (id = component), for every row.

    Documents of equal sets are one class, led by the smallest id. Each lead has a signature of SYMBOLS symbols, cut into CHUNKS
    chunks; for each chunk and each place in it where an error may be, a key holds the other symbols. So two signatures within
    DISTANCE share a key, by pigeonhole. The holders of a key meet in the family of its pivot, the holder with most
    company over all its keys, and pairs within DISTANCE are verified on whole sets until every two members that link are
    connected (see family_links): a group of near copies around one model costs one verification a member.

    Null and empty texts and texts of blanks have no shingles and link with nothing. Rows with a null id are in no group: their component
    is null and they are kept. Rows that share an id are one document, linked by any of its texts. Repeated rows give repeated
    results. Ids may be of any type with an order. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signed, f"id {kind}, n long, d1 long, d2 long, keys array<long>"), "minhash-signed")
    filled, rows = signed.where("id is not null and n > 0"), rows.where("id is not null")
    classes = filled.groupBy("d1", "d2", "n").agg(F.min("id").alias("lead"), F.count("*").alias("copies")).where("copies > 1")
    copies = spread_join(filled.select("id", "d1", "d2", "n"), written(classes, "minhash-classes"), ["d1", "d2", "n"], "copies").where("id <> lead")
    copies = written(copies.groupBy("id", "lead", "d1", "d2").agg(F.count("*").alias("k")).drop("k"), "minhash-copies")
    leads = filled.hint("merge").join(copies.drop("lead"), ["id", "d1", "d2"], "left_anti")
    holders = written(leads.select("id", F.explode("keys").alias("key")), "minhash-keys")
    shared = holders.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("company", F.col("n"))
    held = written(spread_join(holders, written(shared, "minhash-shared"), ["key"], "n"), "minhash-held")
    discard(holders)
    release(spark)
    company = held.groupBy("id").agg(F.sum("company").alias("all"))
    pivots = held.hint("merge").join(company, "id").groupBy("key").agg(F.max_by("id", F.struct("all", F.xxhash64("id"), "id")).alias("pivot"), F.count("*").alias("n"))
    family = spread_join(held.select("id", "key"), written(pivots, "minhash-pivots"), ["key"], "n").groupBy("pivot", "id").agg(F.count("*").alias("k"))
    family = written(family.drop("k"), "minhash-members")
    release(spark)
    links = copies.select(F.col("id").alias("a"), F.col("lead").alias("b")).unionByName(family_links(family, rows, kind))
    found = signed.select("id", "n").hint("merge").join(components(links.distinct()), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return found.select("id", F.col("n").alias("n_shingles"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, w.doc_id = r.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = w.doc_id
"""
