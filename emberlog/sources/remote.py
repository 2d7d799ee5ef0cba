"""Byte ranges of files in shared storage: local paths, file:, hdfs:, s3: and other addresses that pyarrow.fs opens on every node."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs

from emberlog.functions.config import path_pattern

BLOCK_BYTES = 8 << 20
_WILD = re.compile(r"[*?\[]")


def opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of an address, the path in it, and what to put before its paths to make addresses again."""
    if re.match(r"[a-z][a-z0-9+.-]*:", address):
        system, path = fs.FileSystem.from_uri(re.sub(r"[*?\[].*", "", address))
        head = re.sub(r"[*?\[].*", "", address)
        at = head.rfind(path.rstrip("/")) if path.strip("/") else len(head)
        return system, path, head[:at]
    return fs.LocalFileSystem(), address, ""


def listing(pattern: str) -> dict[str, int]:
    """Address and size of each file of a glob; a file without wildcards is itself, if it is there."""
    wild = _WILD.search(pattern)
    base = pattern if wild is None else pattern[: pattern.rfind("/", 0, wild.start()) + 1] or "."
    system, path, head = opened(base)
    if wild is None:
        found = system.get_file_info([path])
    else:
        deep = "/" in pattern[wild.start() :] or "**" in pattern
        found = system.get_file_info(fs.FileSelector(path, recursive=deep, allow_not_found=True))
    fits = re.compile(path_pattern(pattern if "/" in pattern else f"./{pattern}"))
    names = {f"{head}{f.path}": f.size for f in found if f.type == fs.FileType.File}
    return {n: size for n, size in sorted(names.items()) if wild is None or fits.search(n) or fits.search(f"./{n}")}


def read_from(address: str, start: int, length: int) -> bytes:
    system, path, _ = opened(address)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(length)


def last_line_end(address: str, start: int, end: int) -> int:
    """The place after the last line end in start..end; start if there is none."""
    system, path, _ = opened(address)
    with system.open_input_file(path) as f:
        while end > start:
            step = max(start, end - 65536)
            f.seek(step)
            at = f.read(end - step).rfind(b"\n")
            if at >= 0:
                return step + at + 1
            end = step
    return start


def next_line_end(address: str, start: int, end: int) -> int:
    """The place after the first line end in start..end; start if there is none."""
    system, path, _ = opened(address)
    with system.open_input_file(path) as f:
        f.seek(start)
        at = start
        while at < end:
            block = f.read(min(BLOCK_BYTES, end - at))
            found = block.find(b"\n")
            if found >= 0:
                return at + found + 1
            if not block:
                break
            at += len(block)
    return start


def _batch(address: str, at: int, text: bytes) -> pa.RecordBatch:
    """Whole lines, each ended by \\n, as rows; one \\r before the end goes too."""
    data = np.frombuffer(text, np.uint8)
    stop = np.flatnonzero(data == 10)
    first = np.append(0, stop[:-1] + 1)
    cut = stop - ((stop > first) & (data[np.maximum(stop - 1, 0)] == 13))
    keep = np.ones(len(data), bool)
    keep[stop] = keep[cut] = False
    lengths = np.append(0, np.cumsum(cut - first)).astype(np.int32)
    lines = pa.StringArray.from_buffers(len(stop), pa.py_buffer(lengths), pa.py_buffer(np.ascontiguousarray(data[keep])))
    return pa.RecordBatch.from_arrays([pa.array([address] * len(stop), pa.string()), pa.array(at + first), lines], ["file_path", "byte_offset", "line"])


def range_lines(address: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """file_path, byte_offset, line of the lines that begin in start..end; the last may run on, and may lack its line end."""
    system, path, _ = opened(address)
    with system.open_input_file(path) as f:
        at, rest = start, b""
        if start:  # the line that the byte before belongs to is the earlier range's
            f.seek(start - 1)
            at = start - 1
            while True:
                block = f.read(BLOCK_BYTES)
                found = block.find(b"\n")
                if found >= 0:
                    at, rest = at + found + 1, block[found + 1 :]
                    break
                if not block:
                    return
                at += len(block)
        while at < end:
            # A line that begins in the range ends at the first line end from the last place of the range on.
            limit = rest.find(b"\n", max(0, end - 1 - at)) + 1 if at + len(rest) >= end else 0
            cut = limit or rest.rfind(b"\n") + 1
            if cut:
                yield _batch(address, at, rest[:cut])
                at, rest = at + cut, rest[cut:]
                continue
            block = f.read(BLOCK_BYTES)
            if not block:
                if rest:
                    yield _batch(address, at, rest + b"\n")
                return
            rest += block
