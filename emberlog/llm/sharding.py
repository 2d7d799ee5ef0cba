"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from emberlog.llm.common import read, text_bytes, written


class Capacities:
    """A balanced search tree (treap) over (remaining capacity, bin): tightest fit, insert and remove in O(log n)."""

    def __init__(self) -> None:
        self.root = None
        self._state = 88172645463325252

    def _rank(self) -> int:
        x = self._state
        x ^= (x << 13) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 7
        x ^= (x << 17) & 0xFFFFFFFFFFFFFFFF
        self._state = x
        return x

    @staticmethod
    def _cut(node, key):
        """Trees of the keys below key, and of the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = Capacities._cut(node[3], key)
            node[3] = a
            return node, b
        a, b = Capacities._cut(node[2], key)
        node[2] = b
        return a, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Capacities._merge(a[3], b)
            return a
        b[2] = Capacities._merge(a, b[2])
        return b

    def add(self, left: int, number: int) -> None:
        below, above = self._cut(self.root, (left, number))
        self.root = self._merge(self._merge(below, [(left, number), self._rank(), None, None]), above)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least capacity that still holds size."""
        below, fits = self._cut(self.root, (size, -1))
        node = fits
        if node is None:
            self.root = below
            return None
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._cut(fits, (key[0], key[1] + 1))
        self.root = self._merge(below, rest)
        return key


def best_fit_decreasing(items: Iterable[tuple[int, object]], capacity: int) -> list[tuple[object, int]]:
    """(item, bin) for (size, item) pairs. An item larger than capacity gets a bin that holds nothing else."""
    tree, out, bins = Capacities(), [], 0
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        best = tree.take_tightest(size) if size <= capacity else None
        if best is None:
            best, bins = (max(capacity, size), bins), bins + 1
        out.append((item, best[1]))
        tree.add(best[0] - size, best[1])
    return out


def tightest_capacity(items: list[tuple[int, object]], bins: int) -> int:
    """The smallest capacity found by bisection with which best-fit-decreasing needs at most `bins` bins."""
    total, largest = sum(s for s, _ in items), max((s for s, _ in items), default=0)
    low, high = max(largest, -(-total // bins)), max(largest, -(-total // bins)) + largest
    need = lambda c: 1 + max((b for _, b in best_fit_decreasing(items, c)), default=-1)
    while need(high) > bins:
        high *= 2
    for _ in range(24):
        if low >= high:
            break
        mid = (low + high) // 2
        if need(mid) <= bins:
            high = mid
        else:
            low = mid + 1
    return high


def pack(
    docs: DataFrame,
    shards: int | None = 16,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    cells: int = 2048,
    whale_share: int = 8192,
    slot_rows: int = 20_000,
) -> DataFrame:
    """Rows with shard and slot: id, size, text_crc32, digest, shard, slot.

    Equal texts form an indivisible group of the sum of their sizes (UTF-8 bytes + 1). With `capacity`, as few shards of
    that capacity as best-fit-decreasing needs are opened; with `shards`, the smallest capacity that fills at most so
    many is searched for. Groups of at least 1/whale_share of all bytes are packed one by one; there are at most
    whale_share of them. Smaller groups are first dealt by digest to `cells` cells (more when a given capacity is small:
    a cell is kept under 1/64 of it), which are packed like groups: what the driver packs is bounded by
    cells + whale_share, whatever the input's size.

    Slots run from 0 without gaps in each shard. They are offsets of blocks of about slot_rows rows plus the row's place
    in its block (by id, then digest), so no task numbers a whole shard.

    Null text counts as empty. Null ids are numbered first. Repeated rows are rows of their own. Other columns are
    ignored. An empty table gives an empty result.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (text_bytes(text) + 1).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("digest"),
    )
    rows = written(rows, "shard-rows")
    spark = rows.sparkSession
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if capacity is not None:
        cells = max(cells, 64 * -(-total // capacity))
    whale = max(2, -(-total // whale_share))
    cell = F.pmod(F.xxhash64("digest"), F.lit(cells))
    whales = written(groups.where(F.col("bytes") >= whale), "shard-whales")
    large = [(r["bytes"], "w" + r["digest"].hex()) for r in whales.collect()]  # at most whale_share
    small = groups.where(F.col("bytes") < whale).groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"))
    items = large + [(r["bytes"], "c%012d" % r["cell"]) for r in small.collect()]  # at most cells more
    packed = best_fit_decreasing(items, capacity or tightest_capacity(items, shards or 1))
    by_whale = spark.createDataFrame([(bytearray.fromhex(k[1:]), b) for k, b in packed if k[0] == "w"], "digest binary, whale_shard int")
    by_cell = spark.createDataFrame([(int(k[1:]), b) for k, b in packed if k[0] == "c"], "cell long, cell_shard int")
    placed = rows.join(F.broadcast(by_whale), "digest", "left").withColumn("cell", cell).join(F.broadcast(by_cell), "cell", "left")
    placed = placed.withColumn("shard", F.coalesce("whale_shard", "cell_shard")).drop("whale_shard", "cell_shard", "cell")
    return numbered(placed, max(1, count // slot_rows))


def numbered(placed: DataFrame, blocks: int) -> DataFrame:
    """Slots without gaps in each shard: the row's place in its block after the rows of the blocks before it."""
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(W.partitionBy("shard", "block").orderBy("id", "digest"))
    return placed.withColumn("place", place).join(starts, ["shard", "block"]).select(
        "id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pack(read(spark, sf_dir, "documents"), shards=16)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
