"""Sources of text lines with their byte offsets: byte ranges of files in a batch, and a stream that tails growing files.

The built-in text source knows no offsets, and the built-in file stream only sees whole new files. Files are read through
pyarrow.fs on every node, so they lie in shared storage.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from emberlog.sources.remote import last_line_end, listing, next_line_end, range_lines

LINES = "file_path string, byte_offset long, line string"
PIECE_BYTES = 64 << 20


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class RangeReader(DataSourceReader):
    """Pieces of a bounded size of all files of some globs; a line belongs to the piece that it begins in."""

    def __init__(self, patterns: list[str], piece_bytes: int) -> None:
        self.patterns, self.piece_bytes = patterns, piece_bytes

    def partitions(self) -> list[Piece]:
        files = {path: size for pattern in self.patterns for path, size in listing(pattern).items()}
        return [Piece(p, at, min(size, at + self.piece_bytes)) for p, size in files.items() for at in range(0, size, self.piece_bytes)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.path:
            yield from range_lines(piece.path, piece.start, piece.end)


class RangeSource(DataSource):
    """format("loglines") with options path (a glob, or a JSON list of globs) and piece_bytes."""

    @classmethod
    def name(cls) -> str:
        return "loglines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> RangeReader:
        path = self.options["path"]
        return RangeReader(json.loads(path) if path.startswith("[") else [path], int(self.options.get("piece_bytes", PIECE_BYTES)))


class TailReader(DataSourceStreamReader):
    """Offsets are {path: bytes}. A file that shrank is read from 0 at the poll after the one that saw it, a new file from 0.

    most: bytes of one batch, dealt evenly to the files that have more (a line is never cut, so one longer than its
    file's share is a batch's all the same); None: all there is. A file that is gone ends where it was read to; if one of the name
    comes back it is new.
    """

    def __init__(self, pattern: str, earliest: bool, most: int | None = None) -> None:
        self.pattern, self.earliest, self.most, self.seen = pattern, earliest, most, {}

    def initialOffset(self) -> dict:
        self.seen = {p: 0 if self.earliest else size for p, size in listing(self.pattern).items()}
        return dict(self.seen)

    def latestOffset(self) -> dict:
        sizes = listing(self.pattern)
        behind = [p for p, size in sizes.items() if size > self.seen.get(p, 0)]
        share = None if self.most is None else max(1, self.most // max(1, len(behind)))
        found = {}
        for path, size in sizes.items():
            before = self.seen.get(path, 0)
            if size < before:
                found[path] = 0
            elif share is None or size - before <= share:
                found[path] = last_line_end(path, before, size)
            else:
                end = last_line_end(path, before, before + share)
                found[path] = end if end > before else next_line_end(path, before, size)
        self.seen = found
        return dict(found)

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {**start, **end} if not self.seen else self.seen
        # An end before the start: the file was cut, maybe while the stream was down; what it has now is all new.
        first = {p: 0 if stop < start.get(p, 0) else start.get(p, 0) for p, stop in end.items()}
        return [Piece(p, at, min(stop, at + PIECE_BYTES)) for p, stop in sorted(end.items()) for at in range(first[p], stop, PIECE_BYTES)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        try:
            yield from range_lines(piece.path, piece.start, piece.end)
        except FileNotFoundError:  # gone since the poll
            return


class TailSource(DataSource):
    """format("logtail") with options path (a glob), starting_position (latest or earliest) and max_bytes of a batch."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> TailReader:
        most = self.options.get("max_bytes")
        return TailReader(self.options["path"], self.options.get("starting_position", "latest") == "earliest", int(most) if most else None)
