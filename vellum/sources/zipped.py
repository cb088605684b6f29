"""Zip archives as a source that is split by member (SRC8).

The driver reads central directories alone and deals members out, largest first, into
partitions of about ``SPLIT`` bytes; a task seeks to its members and gives their lines in
batches as they are decompressed.  No archive and no member is ever held whole.  Files
are opened by URI, so archives may lie in any store that pyarrow reaches.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.sources.ship import ship

FORMAT = "zipped_lines"
SCHEMA = "archive string, name string, line bigint, text string"
#: Uncompressed bytes of a partition's members, unless a single one has more; lines that
#: are handed on at once, and characters of them.
SPLIT, LINES, CHARACTERS = 64 << 20, 1000, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Members(InputPartition):
    members: list[tuple[str, str]]


class ZipReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Members]:
        store, at = opened(self.path)
        found = store.get_file_info(at)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".zip")] if found.type == fs.FileType.Directory else [at]
        sizes = []
        for file in sorted(files):
            with store.open_input_file(file) as stream, zipfile.ZipFile(stream) as archive:
                sizes += [(i.file_size, file, i.filename) for i in archive.infolist() if not i.is_dir()]
        parts: list[Members] = []
        room = 0
        for size, file, name in sorted(sizes, key=lambda s: (-s[0], s[1:])):
            if not parts or size > room:
                parts.append(Members([]))
                room = self.split
            parts[-1].members.append((file, name))
            room -= size
        return parts

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        by_file: dict[str, list[str]] = {}
        for file, name in partition.members:
            by_file.setdefault(file, []).append(name)
        for file, names in by_file.items():
            with store.open_input_file(file) as stream, zipfile.ZipFile(stream) as archive:
                for name in names:
                    with archive.open(name) as member:
                        yield from batches(file, name, member)


def batches(file: str, name: str, lines: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Numbered lines without their ends; a batch ends early where lines are long."""
    part, size, number = [], 0, 0

    def batch() -> pa.RecordBatch:
        n = len(part)
        cols = {"archive": [file] * n, "name": [name] * n, "line": range(number - n, number), "text": part}
        return pa.RecordBatch.from_pydict({c: list(v) for c, v in cols.items()}, schema=pa.schema([("archive", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("text", pa.string())]))

    for raw in lines:
        part.append(raw.decode("utf-8", "replace").rstrip("\r\n"))
        size, number = size + len(raw), number + 1
        if len(part) == LINES or size >= CHARACTERS:
            yield batch()
            part, size = [], 0
    if part:
        yield batch()


class ZippedLines(DataSource):
    """``load(path)`` of an archive or of a folder of them; option ``split`` in bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options["path"], int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ZippedLines)


def write_archives(members: DataFrame, path: str) -> None:
    """An archive a partition out of ``name, text``, a member a row; names that repeat
    within an archive, and null texts, are left out.

    An archive is written under a name of its own and moved to its partition's when it is
    whole, so a task that is run again replaces what it wrote.
    """

    def write(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, at = opened(path)
        store.create_dir(at, recursive=True)
        number = TaskContext.get().partitionId()
        draft, seen = f"{at}/.{number}-{uuid.uuid4().hex}", set()
        with store.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches_:
                for name, text in zip(batch["name"].to_pylist(), batch["text"], strict=True):
                    if text.is_valid and name not in seen:
                        seen.add(name)
                        archive.writestr(name, text.as_py())
        store.move(draft, f"{at}/part-{number:05}.zip")
        yield pa.RecordBatch.from_pydict({"members": [len(seen)]})

    ship(members.sparkSession)
    members.select("name", "text").mapInArrow(write, "members long").collect()
