"""Lines of files of any size: a data source that reads byte ranges, and line numbers from the ranges' counts."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandbook.sources.scratch import BROADCAST_ROWS

RANGE_BYTES = 64 << 20
#: Bytes of small files, or of short ranges, that one task reads after one another.
SHARE_BYTES = 4 << 20
#: Bytes read at first and at most at once behind a range for the end of its last line; rows and bytes handed on at once.
BEHIND, AHEAD, ROWS, BYTES = 4 << 10, 1 << 20, 50_000, 8 << 20
#: ASCII signs that a file's URI holds escaped.
ESCAPED = ' "<>\\^`{|}%#?[]'
NEWLINE = 10


class Span:
    """Ranges that follow one another in a file: the bytes from ``start`` up to ``end``, ``alone`` if these are the whole file."""

    def __init__(self, root: str, path: str, start: int, end: int, alone: bool):
        self.root, self.path, self.start, self.end, self.alone = root, path, start, end, alone


class Share(InputPartition):
    """What one task reads."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def file_uri(root: str, path: str) -> str:
    """A file's URI as Spark's file metadata has it."""
    where = urlsplit(root if ":" in root else f"file:{root}")
    escaped = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in path)
    if where.scheme == "file":
        return f"file:{escaped}"
    # The path that pyarrow gives begins with the bucket of an object store, but has no host of a file system.
    return f"{where.scheme}://{where.netloc if escaped.startswith('/') else ''}{escaped}"


def files(options: dict[str, str]) -> Iterator[tuple[str, str, int]]:
    """(root, path, size) of the files below the roots, a folder at a time: recursive, of names like ``glob``, modified at or after a time."""
    least = float(options["modifiedafter"]) if options.get("modifiedafter") else None
    for root in json.loads(options["roots"]):
        system, path = file_system(root)
        info = system.get_file_info(path)
        folders = [] if info.type == fs.FileType.File else [path]
        found = [info] if info.type == fs.FileType.File else []
        while found or folders:
            for f in found or sorted(system.get_file_info(fs.FileSelector(folders.pop())), key=lambda f: f.path):
                if f.type == fs.FileType.Directory:
                    folders.append(f.path)
                    continue
                if f.type != fs.FileType.File or not fnmatch.fnmatchcase(f.base_name, options.get("glob") or "*") or f.base_name.startswith(("_", ".")):
                    continue
                if least is not None and f.mtime is not None and f.mtime.replace(tzinfo=f.mtime.tzinfo or timezone.utc).timestamp() < least:
                    continue
                yield root, f.path, f.size
            found = []


def shares(options: dict[str, str]) -> Iterator[Share]:
    """What tasks read. A file's ranges go in spans, so that there are no more of these than files and shares, however short a range is."""
    size, most = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("sharebytes", SHARE_BYTES))
    held, room = [], most
    for root, path, length in files(options):
        at = 0
        while at < length:
            end = length if length - at <= room else at + room // size * size
            if end == at and held:
                yield Share(held)
                held, room = [], most
                continue
            end = end if end > at else min(at + size, length)
            held.append(Span(root, path, at, end, at == 0 and end == length))
            room = max(room - (end - at), 0)
            at = end
    yield Share(held)


def range_lines(f: pa.NativeFile, start: int, end: int) -> tuple[np.ndarray, bytes]:
    """Where each of a range's lines begins, and the last one ends, in the bytes returned with it; line ends belong to their lines.

    A line belongs to the range that its first byte lies in. The byte before the
    range tells whether a line begins at its start, and the last line is read to its end.
    """
    begin = max(start - 1, 0)
    f.seek(begin)
    data = f.read(end - begin)
    if start and data[:1] != b"\n":
        k = data.find(b"\n", 1)
        if k < 0 or begin + k + 1 >= end:  # no line begins here
            return np.zeros(1, np.int64), b""
        data = data[k + 1:]
    elif start:
        data = data[1:]
    if data[-1:] != b"\n":
        rest, step = [data], BEHIND
        while more := f.read(step):
            k = more.find(b"\n")
            rest.append(more if k < 0 else more[:k + 1])
            if k >= 0:
                break
            step = min(2 * step, AHEAD)
        data = b"".join(rest)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == NEWLINE) + 1
    if len(data) and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends]).astype(np.int64), data


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Share]:
        out = list(shares(self.options))
        if self.options.get("mode") != "counts":
            return out
        several = [[s for s in share.spans if not s.alone] for share in out]
        return [Share(s) for s in several if s] or [Share([])]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        counts = self.options.get("mode") == "counts"
        for span in share.spans:
            with file_system(span.root)[0].open_input_file(span.path) as f:
                if counts:
                    yield self._count(f, span)
                else:
                    yield from self._lines(f, span)

    def _ranges(self, f: pa.NativeFile, span: Span) -> Iterator[tuple[np.ndarray, bytes]]:
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        return (range_lines(f, at, min(at + size, span.end)) for at in range(span.start, span.end, size))

    def _count(self, f: pa.NativeFile, span: Span) -> pa.RecordBatch:
        n = sum(len(edges) - 1 for edges, _ in self._ranges(f, span))
        return pa.RecordBatch.from_arrays([pa.array([file_uri(span.root, span.path)]), pa.array([span.start]), pa.array([n])], ["path", "start", "lines"])

    def _lines(self, f: pa.NativeFile, span: Span) -> Iterator[pa.RecordBatch]:
        uri, first, held, rows, size = file_uri(span.root, span.path), 0, [], 0, 0
        for edges, data in self._ranges(f, span):
            held.append((edges, data))
            rows, size = rows + len(edges) - 1, size + len(data)
            if rows >= ROWS or size >= BYTES:
                yield from _batches(uri, span.start, first, held)
                first, held, rows, size = first + rows, [], 0, 0
        yield from _batches(uri, span.start, first, held)


def _batches(uri: str, start: int, first: int, held: list[tuple[np.ndarray, bytes]]) -> Iterator[pa.RecordBatch]:
    """The lines of some ranges that follow one another, of which ``first`` is the place of the first in its span."""
    shifts = np.cumsum([0, *(len(data) for _, data in held)])
    edges = np.concatenate([[0], *(e[1:] + shift for (e, _), shift in zip(held, shifts))]).astype(np.int64)
    data = pa.py_buffer(b"".join(data for _, data in held))
    for lo in range(0, len(edges) - 1, ROWS):
        hi = min(lo + ROWS, len(edges) - 1)
        lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(edges[lo:hi + 1].tobytes()), data]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([uri] * (hi - lo)), pa.array(np.full(hi - lo, start)), pa.array(np.arange(first + lo, first + hi)), lines], ["path", "start", "place", "line"])


class RangedLines(DataSource):
    """Format ``ranged_lines``; options: roots (a JSON list), glob, rangeBytes, shareBytes, modifiedAfter (seconds), mode (lines or counts)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return "path string, start long, lines long" if self.options.get("mode") == "counts" else "path string, start long, place long, line binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None, modified_after: datetime | None = None, range_bytes: int = RANGE_BYTES, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(path, line_no from 0, line): the lines of all files below ``path``, each file read by as many tasks as it has ranges.

    A line's number is its place in its span (the ranges of a file that one task
    reads) and the lines of all spans of the file before; these are counted in a
    first pass, which reads only files of several spans. The driver holds a row for
    each file and each task, none for a range. A line may be longer than a range.
    Storage must be one that pyarrow reads (local, HDFS, S3, GCS). No files give no rows.
    """
    spark.dataSource.register(RangedLines)
    options = {"roots": json.dumps([path] if isinstance(path, str) else list(path)), "glob": glob or "", "rangebytes": str(range_bytes), "sharebytes": str(share_bytes)}
    if modified_after:
        options["modifiedafter"] = str(modified_after.replace(tzinfo=modified_after.tzinfo or timezone.utc).timestamp())
    source = spark.read.format("ranged_lines").options(**options)
    lines = source.option("mode", "lines").load()
    several = sum(not span.alone for share in shares(options) for span in share.spans)
    if several:
        ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
        before = source.option("mode", "counts").load().select("path", "start", F.coalesce(F.sum("lines").over(ahead), F.lit(0)).alias("before"))
        lines = lines.join(F.broadcast(before) if several <= BROADCAST_ROWS else before, ["path", "start"], "left")
    else:
        lines = lines.withColumn("before", F.lit(0).cast("long"))
    return lines.select("path", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("line_no"), F.col("line").cast("string").alias("line"))
