"""Folders with their dot files, and followed log files, from any file system that Arrow opens (SRC3, SRC4, SRC6).

Spark's own file scans skip names that start with a dot, leave out folders
without files, and never look again at a file that they have read.  Both sources
here are read in tasks: the listing by folders, the followed files by byte ranges.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fleetlens.session import scratch_dir

#: Folders of one task, bytes of one task, bytes of a file's content that a listing may carry.
FOLDERS, RANGE, CONTENT = 500, 32 << 20, 1 << 20
#: Names right below a listed tree of one task.
NAMES = 2000
_BACK = 1 << 16
#: Rows of many small folders share a batch; its rows, and the letters of content from which it is full.
ROWS, HELD = 4096, 16 << 20

LISTED = "folder string, name string, path string, length bigint, mtime timestamp, content string, sha256 string"
FOLLOWED = "file string, at bigint, text string"


def open_store(uri: str):
    """The file system of an address, and the path within it."""
    from pyarrow import fs

    place = re.sub(r"^file:/+", "/", uri)
    if re.match(r"^[a-z][a-z0-9+.-]*:", place):
        return fs.FileSystem.from_uri(place)
    return fs.LocalFileSystem(), place


class Folders(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ListingReader(DataSourceReader):
    """One row a file of each folder right below ``path``; an empty folder is one row without name."""

    def __init__(self, options):
        self.path = options["path"]
        self.folders = int(options.get("foldersPerTask", FOLDERS))
        self.digest = options.get("digest", "false") == "true"
        self.wanted = {n for n in options.get("content", "").split(",") if n}

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = sorted(x.path for x in found if x.type == fs.FileType.Directory)
        return [Folders(names[i:i + self.folders]) for i in range(0, len(names), self.folders)] or [Folders([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = open_store(self.path)
        shape = pa.schema([("folder", pa.string()), ("name", pa.string()), ("path", pa.string()), ("length", pa.int64()),
                           ("mtime", pa.timestamp("us", tz="UTC")), ("content", pa.string()), ("sha256", pa.string())])
        rows, held = [], 0
        for place in partition.names:
            folder = posixpath.basename(place.rstrip("/"))
            empty = True
            for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                if x.type != fs.FileType.File:
                    continue
                text = None
                if x.base_name in self.wanted:
                    try:
                        with store.open_input_stream(x.path) as handle:
                            text = handle.read(CONTENT).decode("utf-8", "replace")
                    except OSError:
                        pass  # gone or not readable: its name counts all the same
                empty, held = False, held + len(text or "")
                rows.append((folder, x.base_name, x.path, x.size, x.mtime, text,
                             self._digest(store, x.path) if self.digest else None))
                if len(rows) >= ROWS or held >= HELD:
                    yield self._batch(rows, shape)
                    rows, held = [], 0
            if empty:
                rows.append((folder, *[None] * (len(shape) - 1)))
        if rows:
            yield self._batch(rows, shape)

    @staticmethod
    def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    @staticmethod
    def _digest(store, path: str) -> str | None:
        """Digest of a file of any size, a block at a time; null if it cannot be read."""
        whole = hashlib.sha256()
        try:
            with store.open_input_stream(path) as handle:
                while block := handle.read(CONTENT):
                    whole.update(block)
        except OSError:
            return None
        return whole.hexdigest()


def hidden(name: str, folder: bool) -> bool:
    """Names that Spark's own file scans skip."""
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _entries(store, place: str) -> Iterator[tuple[str, bool]]:
    """Paths right below a folder, and whether each is a folder; names of a local one are never held together."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(place) as found:
            for x in found:
                yield x.path, x.is_dir()
    else:
        for x in store.get_file_info(fs.FileSelector(place)):
            yield x.path, x.type == fs.FileType.Directory


class Block(InputPartition):
    def __init__(self, start: int, end: int, spool: str):
        self.start, self.end, self.spool = start, end, spool


class TreeReader(DataSourceReader):
    """One row a file at any depth below ``path``, names that Spark skips left out.

    The names right below it go to a file, a block of it to each task, so that the driver holds a block's alone.
    """

    def __init__(self, options):
        self.path, self.spool = options["path"], options["spool"]
        self.names = int(options.get("namesPerTask", NAMES))

    def partitions(self) -> list[InputPartition]:
        store, base = open_store(self.path)
        spool = f"{self.spool}/{uuid.uuid4().hex}"
        kept, to = open_store(spool)
        kept.create_dir(posixpath.dirname(to))
        out, held, at = [], [], 0
        with kept.open_output_stream(to) as handle:
            for path, folder in _entries(store, base):
                if not hidden(posixpath.basename(path), folder):
                    held.append(json.dumps([path, folder]))
                if len(held) >= self.names:
                    at, held = self._block(handle, held, at, spool, out), []
            self._block(handle, held, at, spool, out)
        return out

    @staticmethod
    def _block(handle, held: list[str], at: int, spool: str, out: list[InputPartition]) -> int:
        data = "\n".join(held).encode()
        handle.write(data)
        out.append(Block(at, at + len(data), spool))
        return at + len(data)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([("path", pa.string()), ("length", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC"))])
        store, _ = open_store(self.path)
        kept, spool = open_store(partition.spool)
        with kept.open_input_file(spool) as handle:
            names = [json.loads(x) for x in handle.read_at(partition.end - partition.start, partition.start).decode().split("\n") if x]
        files: list[str] = []
        todo = [iter(names)]
        while todo:
            for path, folder in todo[-1]:
                if len(todo) > 1 and hidden(posixpath.basename(path), folder):
                    continue
                if folder:
                    todo.append(_entries(store, path))
                    break
                files.append(path)
                if len(files) >= ROWS:
                    yield self._rows(store, files, shape)
                    files = []
            else:
                todo.pop()
        if files:
            yield self._rows(store, files, shape)

    @staticmethod
    def _rows(store, files: list[str], shape: pa.Schema) -> pa.RecordBatch:
        found = store.get_file_info(files)
        # a time in whole milliseconds, as Hadoop's
        return pa.RecordBatch.from_arrays([
            pa.array([x.path for x in found], pa.string()), pa.array([x.size for x in found], pa.int64()),
            pa.array([None if x.mtime_ns is None else x.mtime_ns // 1_000_000 * 1000 for x in found], pa.int64()).cast(shape.field("mtime").type)],
            schema=shape)


class TreeListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_listing"

    def schema(self) -> str:
        return "path string, length bigint, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class Span(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class FollowReader(DataSourceStreamReader):
    """Lines of growing files, each once, when its line feed has arrived; ``at`` is its first byte.

    The offset is the length of every file so far.  A line belongs to the range
    that holds its line feed; what of it came before is read back.  A file that
    got shorter counts as written anew.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.range = int(options.get("bytesPerTask", RANGE))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {x.path: x.size for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, size in sorted(end.items()):
            begin = start.get(file, 0)
            begin = begin if begin <= size else 0
            out += [Span(file, at, min(at + self.range, size)) for at in range(begin, size, self.range)]
        return out or [Span("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = open_store(self.path)
        shape = pa.schema([("file", pa.string()), ("at", pa.int64()), ("text", pa.string())])
        with store.open_input_file(partition.file) as handle:
            first, head = partition.start, b""
            while first > 0 and b"\n" not in head:
                more = min(_BACK, first)
                first -= more
                head = handle.read_at(more, first) + head
            at = first + head.rfind(b"\n") + 1 if b"\n" in head else 0
            position, rest, rows = partition.start, head[at - first:] if partition.start else b"", []
            while position < partition.end:
                data = handle.read_at(min(1 << 20, partition.end - position), position)
                if not data:
                    break
                position += len(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    rows.append({"file": partition.file, "at": at, "text": line.removesuffix(b"\r").decode("utf-8", "replace")})
                    at += len(line) + 1
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    def commit(self, end: dict) -> None:
        pass


class FollowedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "followed_files"

    def schema(self) -> str:
        return FOLLOWED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FollowReader(self.options)


def list_folders(spark: SparkSession, root: str, content: tuple[str, ...] = (), folders_per_task: int = FOLDERS) -> DataFrame:
    """Files of the folders right below ``root``, dot files and empty folders included.

    The driver lists the folders' names alone.  ``content`` names small files to
    be read along; a missing root gives no rows.
    """
    spark.dataSource.register(FolderListing)
    return (spark.read.format("folder_listing").option("path", root).option("content", ",".join(content))
            .option("foldersPerTask", folders_per_task).load())


def list_tree(spark: SparkSession, root: str, names_per_task: int = NAMES) -> DataFrame:
    """Path, length and time of every file below a local folder, at any depth, as Spark's file scans find them; listed in tasks."""
    spark.dataSource.register(TreeListing)
    return (spark.read.format("tree_listing").option("path", root).option("spool", scratch_dir(spark))
            .option("namesPerTask", names_per_task).load())


def file_digests(spark: SparkSession, root: str, folders_per_task: int = FOLDERS) -> DataFrame:
    """SHA-256 of every file of the folders right below ``root``, read in blocks, so that no file is held whole."""
    listed = (spark.read.format("folder_listing").option("path", root).option("digest", "true")
              .option("foldersPerTask", folders_per_task))
    spark.dataSource.register(FolderListing)
    return listed.load().filter("name is not null").select("folder", "name", "path", "length", "sha256")


def follow_files(spark: SparkSession, root: str, bytes_per_task: int = RANGE) -> DataFrame:
    """A stream of the lines below ``root``, those appended to known files too."""
    spark.dataSource.register(FollowedFiles)
    return spark.readStream.format("followed_files").option("path", root).option("bytesPerTask", bytes_per_task).load()
