"""An inverted index in packed rows: many (key, values) entries of a bucket of keys travel as one compressed row.

Each task gathers entries of some documents, sorts them by key and cuts them by bucket, so the shuffle moves compact
columns and what a task has seen is combined before it. A key's bucket depends on the key alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: Entries that a task gathers before it sends them on, and entries meant for a bucket.
FLUSH, PER_BUCKET = 400_000, 150_000
PACKED = "bucket int, n long, blob binary"


def buckets_for(entries: float) -> int:
    return int(max(1, min(1 << 22, entries // PER_BUCKET)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def pack(columns: list[np.ndarray]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, kind, n, at))
        at += size
    return out


def packed_rows(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))
    blobs = [pack([c[a:b] for c in columns]) for a, b in zip(cut, ends)]
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[cut].astype(np.int32)), "n": pa.array((ends - cut).astype(np.int64)), "blob": pa.array(blobs, pa.binary())})


def gathered(table: pa.Table, kinds: list) -> list[np.ndarray]:
    """The columns of all packed rows of a table."""
    parts = [unpack(b, n, kinds) for b, n in zip(table.column("blob").to_pylist(), table.column("n").to_pylist())]
    return [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal sorted keys, and its length."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return start, np.diff(np.append(start, len(keys)))
