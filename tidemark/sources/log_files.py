"""A partitioned log in files, as a data source with offsets: ``spark.readStream.format("tidemark_log")``.

A log is a folder with one folder for each partition; its segments are files of lines, named by the offset of their
first line. Offsets grow by one a line and are never used again; old segments may be deleted at any time, which moves
the log's begin. Rows have ``partition``, ``offset`` and ``value``.

*Resume.* Spark keeps the offsets of a batch in its checkpoint and asks for the same range again if the batch was not
finished. Before a range is read, its start is checked against [begin, end] of the partition: a start that has been
trimmed away, or that lies behind the end because the log was made anew, falls back to the begin. No record is given
twice, and none that still exists is left out.

*Bounds.* ``maxRecords``: records of one partition in a batch at most. ``minRecords`` and ``maxSeconds``: a batch waits until
as many records are there, or that time has passed since the first of them was seen.

``progress``: a file of the query that is told the offsets after each finished batch. Spark asks for the newest offsets
before it says where it stands, so without this file the first batch of a query is not bounded. Files are reached through Arrow's file systems, on the driver and in tasks alike; tasks read one
segment each, and the driver only lists folders and counts the lines of the last segment of each partition.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "partition int, offset long, value string"
SUFFIX = ".log"
BATCH = 4096


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class Log:
    """The folder of a log as it is now."""

    def __init__(self, path: str):
        self.files, self.path = store(path)
        self._lines: dict[tuple[str, int], int] = {}

    def segments(self) -> dict[int, list[tuple[int, str, int]]]:
        """partition -> (first offset, file, offset behind its last line), in order. Only the last segment is counted."""
        found: dict[int, list[tuple[int, fs.FileInfo]]] = {}
        for f in self.files.get_file_info(fs.FileSelector(self.path, recursive=True, allow_not_found=True)):
            folder = f.path.rsplit("/", 2)[-2]
            if f.is_file and f.base_name.endswith(SUFFIX) and folder.startswith("partition="):
                found.setdefault(int(folder.split("=")[1]), []).append((int(f.base_name.removesuffix(SUFFIX)), f))
        out = {}
        for p, own in found.items():
            own.sort(key=lambda x: x[0])
            ends = [x[0] for x in own[1:]] + [own[-1][0] + self._count(own[-1][1])]
            out[p] = [(first, f.path, end) for (first, f), end in zip(own, ends, strict=True)]
        return out

    def _count(self, f: fs.FileInfo) -> int:
        at = (f.path, f.size)
        if at not in self._lines:
            with self.files.open_input_stream(f.path) as s:
                n = 0
                while block := s.read(1 << 20):
                    n += block.count(b"\n")
            self._lines[at] = n
        return self._lines[at]


@dataclass
class Piece(InputPartition):
    """Lines of one segment: ``skip`` of them are left out, ``take`` are read."""

    partition: int
    file: str
    first: int
    skip: int
    take: int


def pieces(segments: dict[int, list[tuple[int, str, int]]], start: dict[int, int], end: dict[int, int]) -> list[Piece]:
    """The segments' parts from start to end of each partition, start checked against what is there."""
    out = []
    for p, own in segments.items():
        begin, last = own[0][0], own[-1][2]
        a, b = start.get(p, begin), min(end.get(p, last), last)
        if not begin <= a <= last:
            a = begin
        out += [Piece(p, file, first, max(a, first) - first, min(b, behind) - max(a, first)) for first, file, behind in own if max(a, first) < min(b, behind)]
    return out


def _read(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    files, _ = store(path)
    offsets: list[int] = []
    values: list[str] = []

    def batch() -> pa.RecordBatch:
        n = len(offsets)
        return pa.RecordBatch.from_arrays([pa.array([piece.partition] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=["partition", "offset", "value"])

    with files.open_input_stream(piece.file) as s:
        rest, i, last = b"", 0, piece.skip + piece.take
        while i < last and (block := s.read(1 << 20)):
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if piece.skip <= i < last:
                    offsets.append(piece.first + i)
                    values.append(line.decode("utf-8", "replace"))
                i += 1
            while len(offsets) >= BATCH or offsets and i >= last:
                yield batch()
                offsets, values = [], []
    if i < last:
        raise OSError(f"{piece.file} ended early")


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, least: int, seconds: float, progress: str | None):
        self.path, self.most, self.least, self.seconds, self.progress = path, most, least, seconds, progress
        self.log = Log(path)
        self.at: dict[int, int] | None = self._told()
        self.offered: dict[int, int] | None = None
        self.since: float | None = None

    def _begin(self) -> dict[int, int]:
        return {p: own[0][0] for p, own in self.log.segments().items()}

    def _told(self) -> dict[int, int] | None:
        if not self.progress:
            return None
        files, path = store(self.progress)
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return self._begin()
        with files.open_input_stream(path) as s:
            return {int(p): n for p, n in json.loads(s.read()).items()}

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        begin = self._begin()
        self.at = self.at if self.progress else begin
        return {str(p): n for p, n in begin.items()}

    def latestOffset(self) -> dict:  # noqa: N802
        segments = self.log.segments()
        if self.offered is not None:  # Spark has been there already: the file was one batch behind
            self.at = self.offered
        at = self.at or {}
        ready, planned = 0, dict(at)
        for p, own in segments.items():
            begin, end = own[0][0], own[-1][2]
            start = at.get(p, begin)
            start = start if begin <= start <= end else begin
            ready += end - start
            planned[p] = min(end, start + self.most) if self.at is not None else end
        if ready and self.since is None:
            self.since = time.monotonic()
        waited = 0.0 if self.since is None else time.monotonic() - self.since
        if self.at is not None and (not ready or ready < self.least and waited < self.seconds):
            planned = dict(at)
        elif ready:
            self.since, self.offered = None, planned
        return {str(p): n for p, n in planned.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at, self.offered = {int(p): n for p, n in end.items()}, None
        if start == end:
            return []
        return pieces(self.log.segments(), {int(p): n for p, n in start.items()}, self.at)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        if self.progress:
            files, path = store(self.progress)
            with files.open_output_stream(f"{path}.new") as s:
                s.write(json.dumps(end).encode())
            files.move(f"{path}.new", path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return pieces(Log(self.path).segments(), {}, {}) or [Piece(0, "", 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.take else iter(())


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    files: list[tuple[str, int]]


class _Writer(DataSourceWriter):
    """Appends: a task's rows become segments of the partition of its number. Files get their names, and so are seen,
    when all tasks have ended."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def write(self, iterator: Iterator) -> _Written:
        from pyspark import TaskContext

        files, path = store(self.path)
        p = TaskContext.get().partitionId()
        files.create_dir(f"{path}/partition={p}", recursive=True)
        made: list[tuple[str, int]] = []
        lines: list[str] = []

        def close() -> None:
            name = f"{path}/partition={p}/{uuid.uuid4().hex}.new"
            with files.open_output_stream(name) as s:
                s.write("".join(f"{x}\n" for x in lines).encode())
            made.append((name, len(lines)))
            lines.clear()

        for row in iterator:
            if "\n" in (row["value"] or ""):
                raise ValueError("a value holds a line feed")
            lines.append(row["value"] or "")
            if len(lines) == self.size:
                close()
        if lines:
            close()
        return _Written(p, made)

    def commit(self, messages: list) -> None:
        files, path = store(self.path)
        ends = {p: own[-1][2] for p, own in Log(self.path).segments().items()}
        for m in messages:
            at = ends.get(m.partition, 0)
            for name, n in m.files:
                files.move(name, f"{path}/partition={m.partition}/{at:020d}{SUFFIX}")
                at += n

    def abort(self, messages: list) -> None:
        files, _ = store(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                files.delete_file(name)


class LogFiles(DataSource):
    """Options: path; maxRecords, minRecords, maxSeconds, progress (streams); segmentRecords (writing)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _StreamReader:  # noqa: N802, ANN001
        o = self.options
        return _StreamReader(o["path"], int(o.get("maxRecords", 1 << 40)), int(o.get("minRecords", 1)), float(o.get("maxSeconds", 0)), o.get("progress"))

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        if overwrite:
            raise ValueError("a log is only appended to")
        return _Writer(self.options["path"], int(self.options.get("segmentRecords", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogFiles)
