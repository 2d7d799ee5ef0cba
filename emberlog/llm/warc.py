"""WARC records in seekable Zstandard bundles: written and read back by Spark tasks, with a record map for random access.

A bundle is a row of independent Zstandard frames of whole records, then a skippable frame with the record map (record
identifier -> frame number, offset and length in the frame), then a skippable frame with the seek table, whose last nine
bytes (frame count, descriptor, magic) let a reader find every frame from the end of the file. A plain Zstandard decoder
skips both tables and sees the records only.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import read, scratch, small_batches, written

# Fixed values of the seekable format.
SEEK_SKIPPABLE = 0x184D2A5E
MAP_SKIPPABLE = 0x184D2A5D
SEEK_MAGIC = 0x8F92EAB1

#: Tasks of a read, and frames that a look-up task reads.
MOST_TASKS, FRAMES_A_TASK = 20_000, 8

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, intact boolean"


def record_id(page_id: int | None, digest: str) -> str:
    """An identifier by page and payload, so pages of one id but unlike payloads differ; rows without an id get one each."""
    return f"<urn:page:none:{uuid.uuid4().hex}>" if page_id is None else f"<urn:page:{page_id}:{digest[:32]}>"


def page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]+>", identifier or "")
    return int(found[1]) if found else None


def record(identifier: str, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {identifier}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a place, and the place after it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(headers["Content-Length"])
    return headers, data[end + 4 : stop], stop + 4


def decoded(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = headers["WARC-Type"] == "revisit"
    url = headers.get("WARC-Target-URI")
    return {
        "page_id": page_of(headers["WARC-Record-ID"]),
        "url": None if url is None else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]),
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": page_of(headers.get("WARC-Refers-To")),
        "payload": None if revisit else payload,
        "intact": revisit or hashlib.sha256(payload).hexdigest() == digest,
    }


class BundleWriter:
    """One bundle. Memory: a frame's records and the tables."""

    def __init__(self, root: str, name: str, frame_bytes: int) -> None:
        system, path = fs.FileSystem.from_uri(root)
        self.path, self.frame_bytes = f"{root}/{name}", frame_bytes
        system.create_dir(path, recursive=True)
        self.file = system.open_output_stream(f"{path}/{name}", compression=None)
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.open, self.pending, self.table, self.map, self.at = bytearray(), [], [], [], 0

    def add(self, identifier: str, page_id: int | None, data: bytes) -> None:
        self.pending.append((identifier, page_id, len(self.open), len(data)))
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        packed = self.packer.compress(bytes(self.open))
        self.file.write(packed)
        self.map += [(name, page, len(self.table), self.at, len(packed), offset, length) for name, page, offset, length in self.pending]
        self.table.append((len(packed), len(self.open)))
        self.at += len(packed)
        self.open, self.pending = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        places = json.dumps([[name, f, o, n] for name, _, f, _, _, o, n in self.map]).encode()
        seek = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEK_MAGIC)
        for magic, body in ((MAP_SKIPPABLE, places), (SEEK_SKIPPABLE, seek)):
            self.file.write(struct.pack("<II", magic, len(body)) + body)
        self.file.close()
        return [(name, p, self.path, f, start, size, o, n) for name, p, f, start, size, o, n in self.map]


def frames(bundle: str) -> Iterator[tuple[int, bytes]]:
    """Number and records of each frame of a bundle, found by the seek table at its end."""
    system, path = fs.FileSystem.from_uri(bundle)
    with system.open_input_file(path) as f:
        f.seek(f.size() - 9)
        count, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table in {bundle}")
        f.seek(f.size() - 9 - 8 * count)
        table = f.read(8 * count)
        f.seek(0)
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, 8 * k)
            yield k, zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)


def record_map(bundle: str) -> dict[str, list[tuple[int, int, int]]]:
    """Frame number, offset and length by record identifier, as the bundle itself has them."""
    system, path = fs.FileSystem.from_uri(bundle)
    with system.open_input_file(path) as f:
        f.seek(f.size() - 9)
        count, _, _ = struct.unpack("<IBI", f.read(9))
        f.seek(f.size() - 9 - 8 * count)
        start = sum(struct.unpack("<II", f.read(8))[0] for _ in range(count))
        f.seek(start)
        _, size = struct.unpack("<II", f.read(8))
        out: dict[str, list[tuple[int, int, int]]] = {}
        for key, *place in json.loads(f.read(size)):
            out.setdefault(key, []).append(tuple(place))
        return out


def write_bundles(
    pages: DataFrame,
    out_dir: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = 100,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 64 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row to bundles in out_dir; return the index: record_id, page_id, bundle and place.

    Of rows with equal payloads of at least least_revisit bytes (equal SHA-256 and length) the smallest id is a response
    and the others are revisits of it; all other rows are responses. Each task writes bundles of its own under names that
    no other attempt uses; only those of the attempt whose index rows were written count, so a lost executor's bundles
    are written anew. A task holds one frame (frame_bytes, or one record if that is larger).

    Null payloads are empty. Rows with a null id are responses, each with a record identifier of its own. Rows that repeat
    the smallest id of a group are all responses; rows of one id and equal payloads share a record identifier, and the map
    has the place of each. Very long payloads are a frame of their own. A null url has no target header. Other columns are ignored. An empty table
    writes no bundle and gives an empty index.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= least_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    rows = rows.join(firsts, "digest", "left").withColumn("revisit", F.coalesce(F.col("page_id") != F.col("first"), F.lit(False)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in INDEX.split(", ")]
        table = lambda places: pd.DataFrame(places, columns=columns).astype({"page_id": "Int64"})
        writer = None
        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "first", "revisit"))):
                writer = writer or BundleWriter(out_dir, f"bundle-{uuid.uuid4().hex}.warc.zst", frame_bytes)
                page_id = None if pd.isna(page_id) else int(page_id)
                name = record_id(page_id, digest)
                writer.add(name, page_id, record(name, url, bytes(payload), digest, int(first) if revisit else None, bool(revisit), date))
                if writer.at >= bundle_bytes:
                    yield table(writer.close())
                    writer = None
        if writer:
            yield table(writer.close())

    return written(rows.select("page_id", "url", "payload", "digest", "first", "revisit").mapInPandas(save, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that an index names, a frame in memory at a time; intact: the payload has its digest."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for bundle in batch["bundle"]:
                for _, data in frames(bundle):
                    at, found = 0, []
                    while at < len(data):
                        headers, block, at = parse(data, at)
                        found.append(decoded(headers, block))
                        if not payloads:
                            found[-1]["payload"] = None
                    yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    bundles = index.select("bundle").distinct()
    return dealt(bundles, bundles.count(), "bundle").mapInPandas(load, RECORD)


def dealt(rows: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """Rows by hash in so many tasks, MOST_TASKS at most, that small sizes don't merge: each row stands for much to read."""
    return rows.repartition(min(max(1, tasks), MOST_TASKS), F.xxhash64(*columns))


def lookup(index: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The records of some ids, reading their frames only: the index gives bundle, frame and offset."""
    wanted = index.join(ids.select(F.col(id_col).alias("page_id")).distinct(), "page_id", "left_semi")
    names = [x.split()[0] for x in RECORD.split(", ")]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (bundle, start, size), part in batch.groupby(["bundle", "frame_start", "frame_bytes"]):
                system, path = fs.FileSystem.from_uri(bundle)
                with system.open_input_file(path) as f:
                    f.seek(start)
                    data = zstandard.ZstdDecompressor().decompress(f.read(size))
                found = [decoded(*parse(data, at)[:2]) for at in part["offset"]]
                yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return dealt(wanted, wanted.select("bundle", "frame").distinct().count() // FRAMES_A_TASK, "bundle", "frame").mapInPandas(load, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_bundles(read(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return read_bundles(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), q AS (SELECT *, strlen(html) >= 100 AND page_id <> first AS revisit FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN first END AS refers_to
FROM q
"""
