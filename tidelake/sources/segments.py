"""Segments: containers of many members behind one index, read by ranges and written whole.

A segment is a magic, the length of its index (8 bytes, little endian), the index as
JSON {"members": [{"id", "offset", "length", "sha256"}]} with offsets from its end, and
the members one after the other. register(spark) makes the format "tidelake_segment":

    spark.read.format("tidelake_segment").option("ids", "a,b").load(folder)

A task reads the index and, of the members that begin in its range of the file, only the
wanted ones; files are never loaded whole. With the option "pushdown", and Spark's setting
for it, conditions on id are met there too. Paths are local or URIs that Arrow opens.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

MAGIC = b"TIDESEG1"
SUFFIX = ".seg"
SCHEMA = "path string, id string, offset long, length long, sha256 string, content binary"
#: An index of more bytes is refused before it is read.
LARGEST_INDEX = 64 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def index_bytes(stream, size: int, path: str, magic: bytes = MAGIC) -> tuple[bytes, int]:
    """The index of a container and where its members' bytes begin; nothing else is read."""
    head = stream.read(len(magic) + 8)
    if head[: len(magic)] != magic:
        raise ValueError(f"{path} has another magic")
    length = int.from_bytes(head[len(magic) :], "little")
    if len(head) < len(magic) + 8 or length > min(size - len(head), LARGEST_INDEX):
        raise ValueError(f"the index of {path} is cut off or too long")
    return stream.read(length), len(head) + length


def index_of(stream, size: int, path: str) -> tuple[list[dict], int]:
    """Members of a segment and where their bytes begin; a malformed index is refused."""
    index, begin = index_bytes(stream, size, path)
    members, seen = json.loads(index)["members"], set()
    for m in members:
        if m["id"] in seen:
            raise ValueError(f"{path} has two members {m['id']}")
        if m["offset"] < 0 or m["length"] < 0 or begin + m["offset"] + m["length"] > size:
            raise ValueError(f"member {m['id']} of {path} lies outside the file")
        seen.add(m["id"])
    return members, begin


def read_members(stream, size: int, path: str, first: int, last: int, ids: set[str] | None = None, content: bool = True) -> Iterator[tuple]:
    """Rows of the members that begin at a byte from first to last - 1; bytes that do not have their digest are refused."""
    members, begin = index_of(stream, size, path)
    for m in members:
        # A member without bytes at the very end of the file belongs to the last range.
        at = min(begin + m["offset"], size - 1)
        if not first <= at < last or ids is not None and m["id"] not in ids:
            continue
        data = None
        if content:
            stream.seek(begin + m["offset"])
            data = stream.read(m["length"])
            if hashlib.sha256(data).hexdigest() != m["sha256"]:
                raise ValueError(f"member {m['id']} of {path} is not what its digest says")
        yield path, m["id"], m["offset"], m["length"], m["sha256"], data


def files_below(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder with a suffix, but for those in folders that begin with an underscore."""
    system, path = opened(path)
    here = system.get_file_info(path)
    found = [here] if here.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f is here or f.path.endswith(suffix) and "/_" not in f.path[len(path) :]))


@dataclass
class Range(InputPartition):
    path: str
    size: int
    first: int
    last: int


class SegmentReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("split_bytes", 128 << 20))
        self.content = str(options.get("content", "true")).lower() == "true"
        self.ids = set(options["ids"].split(",")) if options.get("ids") else None

    def partitions(self) -> list[Range]:
        return [Range(path, size, a, min(a + self.split, size)) for path, size in files_below(self.path, SUFFIX) for a in range(0, max(1, size), self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as stream:
            yield from read_members(stream, partition.size, partition.path, partition.first, partition.last, self.ids, self.content)


class PushingReader(SegmentReader):
    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Equality and membership of ids are met while reading; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class SegmentWriter(DataSourceWriter):
    """Rows (segment, id, content), a segment's together: members are spilled as they come, and the index written before them once all are known.

    Files stand aside until every task is done; a task that runs twice leaves one copy.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        system, root = opened(self.path)
        aside, files, name, members, body = f"{root}/_job-{self.job}/{uuid.uuid4().hex}", [], None, [], None
        system.create_dir(aside, recursive=True)

        def close() -> None:
            if name is None:
                return
            body.close()
            index = json.dumps({"members": members}, separators=(",", ":")).encode()
            with system.open_output_stream(f"{aside}/{name}{SUFFIX}") as out, system.open_input_stream(f"{aside}/body") as data:
                out.write(MAGIC + len(index).to_bytes(8, "little") + index)
                while block := data.read(1 << 20):
                    out.write(block)
            system.delete_file(f"{aside}/body")
            files.append(f"{aside}/{name}{SUFFIX}")

        for segment, id_, content in rows:
            if segment != name:
                close()
                name, members, body = segment, [], system.open_output_stream(f"{aside}/body")
            content = bytes(content)
            members.append({"id": id_, "offset": members[-1]["offset"] + members[-1]["length"] if members else 0, "length": len(content), "sha256": hashlib.sha256(content).hexdigest()})
            body.write(content)
        close()
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        system, root = opened(self.path)
        fresh = [f for m in messages if m for f in m.files]
        names = [f.rsplit("/", 1)[1] for f in fresh]
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(SUFFIX)]
        clash = set(names) & {f.rsplit("/", 1)[1] for f in old}
        if len(names) != len(set(names)) or clash and not self.overwrite:
            self.abort(messages)
            raise ValueError("a segment was written by two tasks, or is there already")
        for f in old if self.overwrite else []:
            system.delete_file(f)
        for f, n in zip(fresh, names, strict=True):
            system.move(f, f"{root}/{n}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, root = opened(self.path)
        system.delete_dir(f"{root}/_job-{self.job}") if system.get_file_info(f"{root}/_job-{self.job}").type == fs.FileType.Directory else None


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelake_segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        # Spark refuses readers that take filters unless spark.sql.python.filterPushdown.enabled is set.
        return (PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else SegmentReader)(self.options)

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options, overwrite)


class HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.magic = options["path"], bytes.fromhex(options.get("magic", MAGIC.hex()))

    def partitions(self) -> list[Range]:
        return [Range(path, size, 0, size) for path, size in files_below(self.path)]

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as stream:
            try:
                yield partition.path, index_bytes(stream, partition.size, partition.path, self.magic)[0], None
            except ValueError as fault:
                yield partition.path, None, str(fault)


class HeaderSource(DataSource):
    """(path, header, fault) of containers with a magic of the option "magic" (hex): the bytes of their index, or what is wrong with it."""

    @classmethod
    def name(cls) -> str:
        return "tidelake_header"

    def schema(self) -> str:
        return "path string, header binary, fault string"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SegmentSource)
    spark.dataSource.register(HeaderSource)


def write_segments(df: DataFrame, path: str, segment: str, order: str, id_col: str, content: str, mode: str = "append") -> None:
    """One file a segment, its members in order; a segment's rows meet in one task, sorted, and pass through it one by one."""
    register(df.sparkSession)
    rows = df.repartition(segment).sortWithinPartitions(segment, order).selectExpr(f"CAST({segment} AS STRING) AS segment", f"CAST({id_col} AS STRING) AS id", f"CAST({content} AS BINARY) AS content")
    rows.write.format("tidelake_segment").mode(mode).save(path)
