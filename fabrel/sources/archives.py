"""Lines of archives and compressed dumps as a data source: a partition for each member, read as a stream, with early exit."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines of one Arrow batch, and bytes that are unpacked at once.
BATCH, CHUNK = 10_000, 1 << 18


@dataclass
class Member(InputPartition):
    """A member of an archive; of a tar, which has no directory, all members (None)."""

    archive: str
    member: str | None


def _opened(path: str):
    """A file that can be sought in, of the local or any other file system that pyarrow knows."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted(head + f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")  # hidden ones as Spark does


def _lines(stream) -> Iterator[str]:
    """The lines of a stream that can only be read forward."""
    left = b""
    while chunk := stream.read(CHUNK):
        *whole, left = (left + chunk).split(b"\n")
        for line in whole:
            yield line.rstrip(b"\r").decode("utf-8", "replace")
    if left:
        yield left.rstrip(b"\r").decode("utf-8", "replace")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.pattern = options.get("pattern")
        self.limit = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            if path.endswith(".zip"):
                with _opened(path) as f, zipfile.ZipFile(f) as z:  # the directory at its end, no member
                    out += [Member(path, i.filename) for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)]
            else:
                out.append(Member(path, None))
        return out

    def streams(self, p: Member) -> Iterator[tuple[str, io.BufferedIOBase]]:
        with _opened(p.archive) as f:
            if p.member is not None:
                with zipfile.ZipFile(f) as z, z.open(p.member) as m:
                    yield p.member, m
            elif re.search(r"\.(tar|tgz|tar\.\w+)$", p.archive):
                with tarfile.open(fileobj=f, mode="r|*") as t:  # as a stream: one member after the other
                    for m in t:
                        if m.isfile() and m.name.endswith(self.suffix):
                            yield m.name, t.extractfile(m)
            else:
                name = p.archive.rpartition("/")[2]
                unpack = {"gz": lambda x: gzip.GzipFile(fileobj=x), "bz2": bz2.BZ2File}.get(name.rpartition(".")[2])
                yield name, unpack(f) if unpack else f

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        wanted, left = re.compile(self.pattern) if self.pattern else None, self.limit
        for member, stream in self.streams(partition):
            lines: list[str] = []
            for line in _lines(stream) if left != 0 else ():
                if wanted and not wanted.search(line):
                    continue
                lines.append(line)
                if left is not None:
                    left -= 1
                if len(lines) == BATCH or left == 0:
                    yield self.batch(partition, member, lines)
                    lines = []
                if left == 0:
                    return
            if lines:
                yield self.batch(partition, member, lines)

    def batch(self, p: Member, member: str, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [p.archive] * len(lines), "member": [member] * len(lines), "line": lines})


class Archive(DataSource):
    """`archive`: options path (a file or a folder of them), suffix of members, pattern that lines must hold, limit of lines."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, member string, line string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def archive_lines(spark: SparkSession, path: str, *, suffix: str = "", pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """(archive, member, line) of zip and tar archives and of gz and bz2 dumps, a file or a folder of them.

    Members of zip archives are read by tasks of their own, all others an archive a task; each as a stream of lines, so
    memory does not grow with the archive. With a limit a task stops once so many lines have passed the pattern, without reading
    the rest, and the result has so many rows at most.
    """
    spark.dataSource.register(Archive)
    reader = spark.read.format("archive").option("path", path).option("suffix", suffix)
    reader = reader.option("pattern", pattern) if pattern else reader
    df = (reader.option("limit", limit) if limit is not None else reader).load()
    return df if limit is None else df.limit(limit)
