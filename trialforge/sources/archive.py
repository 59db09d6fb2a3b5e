"""Members of tar and zip archives as rows: a Spark data source that reads them by offset from any file system.

An archive is never held: the plan lists members from their headers (a seek each) and deals them out by bytes; a task
reads its members one at a time. A compressed tar has no offsets and is one task's stream, again a member at a time.
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

SCHEMA = "archive string, folder string, member string, bytes long, content binary"
#: Spark's limit for one value.
MOST_BYTES = 2**31 - 64


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The files that a path names: itself, those of a folder, or those that match its last part; in order of name."""
    fs, at = _system(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else path[: path.index(":") + 1]
    if re.search(r"[*?\[]", at.rpartition("/")[2]):
        folder, _, pattern = at.rpartition("/")
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern)]
    else:
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [at] if info.is_file else [f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file]
    return sorted(prefix + f for f in found)


@dataclass
class Part(InputPartition):
    """Members of one archive: (name, offset of its bytes, size); no members: the whole of a compressed tar."""

    archive: str
    kind: str
    members: tuple[tuple[str, int, int], ...]


class _Folders:
    """A folder's members lie together: one that comes back after another is an error."""

    def __init__(self, archive: str):
        self.archive, self.last, self.past = archive, None, set()

    def see(self, name: str) -> None:
        folder = name.rpartition("/")[0]
        if folder != self.last:
            if folder in self.past:
                raise ValueError(f"{self.archive}: {folder} is in two parts")
            self.past.add(folder)
            self.last = folder


def _open(archive: str):
    fs, at = _system(archive)
    return fs.open_input_file(at)


def index(archive: str, wanted: re.Pattern) -> tuple[str, list[tuple[str, int, int]]]:
    """(kind, members whose names match): tar and zip list them; a compressed tar can't without reading it."""
    with _open(archive) as f:
        head = f.read(4)
        f.seek(0)
        if head[:2] == b"PK":
            with zipfile.ZipFile(f) as z:
                return "zip", [(m.filename, m.header_offset, m.file_size) for m in z.infolist() if not m.is_dir() and wanted.search(m.filename)]
        if head[:2] in (b"\x1f\x8b", b"BZ") or head == b"\xfd7zX":
            return "stream", []
        out, folders = [], _Folders(archive)
        with tarfile.open(fileobj=f, mode="r:") as tar:
            for m in tar:
                tar.members = []  # else every header stays
                if m.isfile():
                    folders.see(m.name)
                    if wanted.search(m.name):
                        out.append((m.name, m.offset_data, m.size))
        return "tar", out


def _row(archive: str, name: str, content: bytes) -> pa.RecordBatch:
    folder, _, member = name.rpartition("/")
    cols = [pa.array([archive]), pa.array([folder]), pa.array([member]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["archive", "folder", "member", "bytes", "content"])


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.wanted, self.part_bytes = options["path"], options.get("wanted", ".*"), int(options.get("partbytes", 64 << 20))

    def partitions(self) -> list[Part]:
        out, pattern = [], re.compile(self.wanted)
        for archive in files_of(self.paths):
            kind, members = index(archive, pattern)
            if kind == "stream":
                out.append(Part(archive, kind, ()))
            held, size = [], 0
            for m in members:
                if held and size + m[2] > self.part_bytes:
                    out.append(Part(archive, kind, tuple(held)))
                    held, size = [], 0
                held.append(m)
                size += m[2]
            if held:
                out.append(Part(archive, kind, tuple(held)))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for name, _, size in part.members:
            if size > MOST_BYTES:
                raise ValueError(f"{part.archive}: {name} has {size} bytes, more than a value can hold")
        with _open(part.archive) as f:
            if part.kind == "tar":
                for name, at, size in part.members:
                    f.seek(at)
                    yield _row(part.archive, name, f.read(size))
            elif part.kind == "zip":
                with zipfile.ZipFile(f) as z:
                    for name, _, _ in part.members:
                        yield _row(part.archive, name, z.read(name))
            else:
                pattern, folders = re.compile(self.wanted), _Folders(part.archive)
                with tarfile.open(fileobj=f, mode="r|*") as tar:
                    for m in tar:
                        tar.members = []
                        if m.isfile():
                            folders.see(m.name)
                            if pattern.search(m.name):
                                if m.size > MOST_BYTES:
                                    raise ValueError(f"{part.archive}: {m.name} has {m.size} bytes, more than a value can hold")
                                yield _row(part.archive, m.name, tar.extractfile(m).read())


class ArchiveSource(DataSource):
    """spark.read.format("members"): options path (a file, a folder or a pattern), wanted (a pattern of names), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, path: str, wanted: str = ".*", part_bytes: int = 64 << 20) -> DataFrame:
    """archive, folder, member, bytes, content of the members whose names match.

    A folder's members must lie together in a tar: a folder that comes back after another is an error. No archive is too
    large; a member of 2 GiB or more is an error if it is wanted, and no matter else.
    """
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("members").option("wanted", wanted).option("partBytes", part_bytes).load(path)


def member_manifest(members: DataFrame) -> DataFrame:
    """archive, folder, member, bytes, rows (lines that aren't blank; null for what isn't text), sha256."""
    text = F.col("member").rlike(r"\.(txt|csv|tsv|json|jsonl)$")
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit(r"(?m)^.*\S.*$"))
    return members.select("archive", "folder", "member", "bytes", F.when(text, lines).cast("long").alias("rows"), F.sha2("content", 256).alias("sha256"))
