"""A data source of archives that may be damaged: what can be read is read, and what was lost is told.

A large file is a partition, read as a stream, so that a task holds a record and a batch of rows at a time; small files
share one, so that their number costs no task each. A gzip file that
ends early, or whose data are broken from some point on, gives its rows up to there and is ``truncated``; bytes that
aren't UTF-8 become the replacement character; a last record that isn't complete is dropped and counted. No setting of
the session changes, so that other reads still fail on damaged files.

Files are opened by their URI through Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import codecs
import contextlib
import fnmatch
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, n bigint, value string, truncated boolean, dropped bigint"
CHUNK = 1 << 20
#: Bytes of a zipped file that are taken at a time.
PIECE = 1 << 14
#: Characters of records in a batch.
BATCH_CHARS = 4 << 20
#: Bytes of files that a task takes, what opening one weighs in bytes, and tasks that there should be if files are few.
TASK_BYTES, OPEN_BYTES, TASKS = 32 << 20, 64 << 10, 64
RECORDS = ("line", "block", "entry")


def _all_of(member, data: bytes) -> Iterator[bytes]:
    out = member.decompress(data, CHUNK)
    while out:
        yield out
        out = member.decompress(member.unconsumed_tail, CHUNK)


class Stream:
    """The lines of a file. After the last one ``truncated`` tells whether the file was damaged, ``rest`` what came last
    without a line end."""

    def __init__(self, raw, zipped: bool) -> None:
        self.raw, self.zipped, self.truncated, self.rest = raw, zipped, False, ""

    def _inflated(self) -> Iterator[bytes]:
        if not self.zipped:
            while data := self.raw.read(CHUNK):
                yield data
            return
        member, began = zlib.decompressobj(31), False
        while data := self.raw.read(PIECE):
            while data:
                if member.eof:
                    # Further members may follow; zeros between and behind them are padding.
                    data = data.lstrip(b"\0")
                    if not data:
                        break
                    member = zlib.decompressobj(31)
                began, before = True, member.copy()
                try:
                    out = list(_all_of(member, data))
                except zlib.error:
                    # What the piece gives before it breaks, byte by byte.
                    self.truncated = True
                    with contextlib.suppress(zlib.error):
                        for k in range(len(data)):
                            yield from _all_of(before, data[k : k + 1])
                    return
                yield from out
                data = member.unused_data
        self.truncated = began and not member.eof

    def __iter__(self) -> Iterator[str]:
        decoder = io.IncrementalNewlineDecoder(codecs.getincrementaldecoder("utf-8")("replace"), translate=True)
        parts: list[str] = []
        for data in self._inflated():
            text = decoder.decode(data)
            if "\n" not in text:
                parts.append(text)
                continue
            lines = ("".join(parts) + text).split("\n")
            parts = [lines.pop()]
            yield from lines
        self.rest = "".join(parts) + ("" if self.truncated else decoder.decode(b"", final=True))
        # The end of a whole file ends its last line; that of a damaged one lies inside of it.
        if self.rest and not self.truncated:
            yield self.rest
            self.rest = ""


def records(stream: Stream, kind: str) -> Iterator[tuple[str, bool]]:
    """(record, whether it's complete): lines; blocks that a line ``//`` ends, without it; entries that ``>`` begins."""
    held: list[str] = []
    for line in stream:
        if kind == "line":
            yield line, True
        elif kind == "block":
            if line.strip() == "//":
                yield "\n".join(held), True
                held = []
            else:
                held.append(line)
        else:
            if line.startswith(">") and held:
                yield "\n".join(held), True
                held = []
            if held or line.startswith(">"):
                held.append(line)
    if held and kind == "entry" and not stream.truncated:
        yield "\n".join(held), True
    elif held or stream.rest:
        yield "\n".join(held), False


class Archives(InputPartition):
    """Paths of the files that a task reads one after the other."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)


def dealt(files: list[tuple[str, int]]) -> list[list[str]]:
    """(path, bytes) of files as lists of paths, in order: one task's, which are within its bytes or a single file."""
    weighed = [(path, size + OPEN_BYTES) for path, size in files]
    most = min(TASK_BYTES, sum(w for _, w in weighed) // TASKS)
    found: list[list[str]] = []
    full = most + 1
    for path, weight in weighed:
        if full + weight > most:
            found.append([])
            full = 0
        found[-1].append(path)
        full += weight
    return found


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.pattern, self.kind = options["path"], options.get("pattern", "*"), options.get("record", "line")
        if self.kind not in RECORDS:
            raise ValueError(f"a record is one of {', '.join(RECORDS)}")

    def partitions(self) -> list[Archives]:
        system, below = fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(below)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(below, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Archives(p) for p in dealt([f for f in files if info.type == fs.FileType.File or fnmatch.fnmatch(f[0].rsplit("/", 1)[-1], self.pattern)])]

    def read(self, partition: Archives | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        yield from self.read_files(system, partition.value)

    def read_files(self, system: fs.FileSystem, paths: list[str]) -> Iterator[pa.RecordBatch]:
        for path in paths:
            yield from self.read_file(system, path)

    def read_file(self, system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:

        def batch(first: int, values: list, truncated: bool | None = None, dropped: int | None = None) -> pa.RecordBatch:
            n = len(values)
            columns = ([path] * n, range(first, first + n), values, [truncated] * n, [dropped] * n)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        n, dropped, held, chars = 0, 0, [], 0
        with system.open_input_stream(path, compression=None) as raw:
            stream = Stream(raw, path.endswith(".gz"))
            for value, complete in records(stream, self.kind):
                if not complete:
                    dropped += 1
                    continue
                held.append(value)
                chars += len(value)
                if chars >= BATCH_CHARS:
                    yield batch(n, held)
                    n, held, chars = n + len(held), [], 0
        if held:
            yield batch(n, held)
        yield batch(n + len(held), [None], stream.truncated, dropped)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, pattern: str = "*", record: str = "line") -> DataFrame:
    """(path, n, value, truncated, dropped) of the files below a folder, or of one file, by ``pattern`` of their names.

    Rows with a ``value`` are records, numbered in their file from 0. Each file ends with a row without one, in which ``n``
    is the number of its records, ``truncated`` tells whether it was damaged and ``dropped`` counts incomplete records.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").option("path", path).option("pattern", pattern).option("record", record).load()


def blocks(archives: DataFrame) -> DataFrame:
    """(block, pos) of the records, as the readers of flat files take them; blank ones go."""
    pos = F.struct(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("file_block_start"), "n").alias("pos")
    block = F.regexp_replace(F.regexp_replace("value", r"^[ \t]*\n*", ""), r"\s+$", "")
    return archives.where("value IS NOT NULL").select(block.alias("block"), pos).where("block <> ''")


def states(archives: DataFrame) -> DataFrame:
    """(path, records, truncated, dropped) of each file."""
    return archives.where("value IS NULL").select("path", F.col("n").alias("records"), "truncated", "dropped")


OBJECT_SCHEMA = "path string, n bigint, key string, value string"


def entries(stream: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(key, JSON text of the value) of the JSON object that pieces of text make up, one at a time.

    An empty text and one that isn't an object have none; an object that breaks off or isn't JSON is an error.
    """
    decoder, held, at, more = json.JSONDecoder(), "", 0, True

    def fill() -> bool:
        """Take up more text; what lies before ``at`` is done with."""
        nonlocal held, at, more
        piece = next(stream, None)
        if piece is None:
            more = False
            return False
        held, at = held[at:] + piece, 0
        return True

    def token() -> str:
        """The next character that isn't white space; empty at the end."""
        nonlocal at
        while True:
            while at < len(held) and held[at] in " \t\r\n\ufeff":
                at += 1
            if at < len(held) or not fill():
                return held[at : at + 1]

    def value() -> tuple[object, str]:
        nonlocal at
        token()
        while True:
            try:
                found, end = decoder.raw_decode(held, at)
            except ValueError:
                if not fill():
                    raise
                continue
            # A number may go on in the next piece.
            if (end == len(held) or held[end] in ".eE") and more and fill():
                continue
            text = held[at:end]
            at = end
            return found, text

    if token() != "{":
        return
    at += 1
    if token() == "}":
        return
    while True:
        key, _ = value()
        if not isinstance(key, str) or token() != ":":
            raise ValueError("a key and a colon are expected")
        at += 1
        _, text = value()
        yield key, text
        mark = token()
        at += 1
        if mark == "}":
            return
        if mark != ",":
            raise ValueError("a comma or the object's end is expected")


class ObjectReader(ArchiveReader):
    """The entries of one JSON object in each file, whose values are objects; the file is never held as a whole."""

    def read_files(self, system: fs.FileSystem, paths: list[str]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OBJECT_SCHEMA.split(", ")]

        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def pieces(raw) -> Iterator[str]:
            decoder = codecs.getincrementaldecoder("utf-8")()
            while data := raw.read(CHUNK):
                yield decoder.decode(data)
            yield decoder.decode(b"", final=True)

        held, chars = [], 0  # batches go on from file to file
        for path in paths:
            with system.open_input_stream(path) as raw:
                for n, (key, value) in enumerate(entries(pieces(raw))):
                    if not value.startswith("{"):
                        continue
                    held.append((path, n, key, value))
                    chars += len(value)
                    if chars >= BATCH_CHARS:
                        yield batch(held)
                        held, chars = [], 0
        if held:
            yield batch(held)


class ObjectSource(ArchiveSource):
    @classmethod
    def name(cls) -> str:
        return "json-objects"

    def schema(self) -> str:
        return OBJECT_SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, n, key, value) of the JSON object in each file, values as JSON texts; values that aren't objects go.

    ``n`` numbers a file's entries from 0, repeated keys included. A task holds an entry and a batch of rows at a time.
    """
    spark.dataSource.register(ObjectSource)
    return spark.read.format("json-objects").option("path", path).option("pattern", pattern).load()
