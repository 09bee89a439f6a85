"""Folders of text files as a Spark data source: ``spark.read.format("text_corpus").load(folder)``.

The driver lists names and sizes only, or, with ``listing`` = ``tasks``, folders only: then each task lists some of them itself, so a
corpus of many small files in many folders never stands in the driver's memory.  Conditions on ``extension``, ``path`` and ``length`` are answered by the listing
(``spark.sql.python.filterPushdown.enabled``, which :func:`register` turns on), so files they leave out are never opened.
What is left is packed into partitions by size, as Spark packs its own files (folders that tasks list: in up to 256 equal parts); a
file is read whole by one task.

Written with ``df.write.format("text_corpus").mode("append").save(folder)``, a table (path, content) becomes one file a row, ``path``
being relative to the folder.  A task writes each file under a name of its own and renames it, so what a lost or repeated
task leaves is whole; names must not repeat within a table.

Options: ``extensions`` (comma-separated; others are left out of every read), ``listing`` (``driver``), ``maxPartitionBytes`` (128 MiB),
``openCostInBytes`` (64 KiB: a small file costs far less than the start of a task).  Folders are local paths or addresses that ``pyarrow.fs`` opens (``file:``, ``hdfs:``, ``s3:``).

Defined cases: an empty folder gives no rows, a missing one is an error; files and folders whose names begin with ``.``
or ``_`` are left out; an empty file is one row with empty content; a file without an extension has an empty one; null
paths cannot be written, null contents become empty files.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import Row

from quireframe.functions.encoding import encoding_warning, with_decoded

SCHEMA = "path string, extension string, length long, content binary"

#: Conditions that a listing can answer, as tests of a value against the condition's.
TESTS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, StringStartsWith: str.startswith, StringEndsWith: str.endswith,
    GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
}
FOLDER_PARTS = 256
LISTED = {("path",): 0, ("extension",): 1, ("length",): 2}


@dataclass(frozen=True)
class Entry:
    path: str
    extension: str
    length: int

    def value(self, k: int):
        return (self.path, self.extension, self.length)[k]


@dataclass
class Files(InputPartition):
    entries: list[Entry]


@dataclass
class Folders(InputPartition):
    folders: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: int


def open_folder(address: str):
    """The file system of an address and the folder's path in it."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", address):  # Spark's own short form
        address = "file://" + address[5:]
    return fs.FileSystem.from_uri(address) if ":/" in address else (fs.LocalFileSystem(), posixpath.abspath(address))


def extension_of(path: str) -> str:
    return posixpath.splitext(path)[1][1:].lower()


def packed(entries: list[Entry], most: int, cost: int) -> list[Files]:
    """Entries in groups of at most ``most`` bytes, each file counted with the cost of opening it, the largest first."""
    out, held = [], 0
    for e in sorted(entries, key=lambda e: (-e.length, e.path)):
        if not out or held + e.length + cost > most:
            out.append(Files([]))
            held = 0
        out[-1].entries.append(e)
        held += e.length + cost
    return out


class TextCorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.address = options["path"]
        self.most, self.cost = int(options.get("maxPartitionBytes", 128 << 20)), int(options.get("openCostInBytes", 64 << 10))
        self.in_tasks = options.get("listing", "driver") == "tasks"
        names = {x.strip().lower().lstrip(".") for x in options.get("extensions", "").split(",") if x.strip()}
        self.filters: list[Filter] = [In(("extension",), tuple(sorted(names)))] if names else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in LISTED:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, e: Entry) -> bool:
        return all(f.value is not None and TESTS[type(f)](e.value(LISTED[f.attribute]), f.value) for f in self.filters)

    def _listed(self, system, folder: str, recursive: bool = True) -> tuple[list[Entry], list[str]]:
        """Wanted files of a folder, and the folders in it."""
        from pyarrow import fs

        files, folders = [], []
        for info in system.get_file_info(fs.FileSelector(folder, recursive=recursive)):
            inside = info.path[len(folder) :].strip("/").split("/")
            if any(p.startswith((".", "_")) for p in inside):
                continue
            if info.type == fs.FileType.Directory:
                folders.append(info.path)
            elif info.type == fs.FileType.File and self._wanted(e := Entry(info.path, extension_of(info.path), info.size)):
                files.append(e)
        return files, folders

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.address)
        if not self.in_tasks:
            return packed(self._listed(system, root)[0], self.most, self.cost) or [Files([])]
        files, folders = self._listed(system, root, recursive=False)
        each = -(-len(folders) // FOLDER_PARTS) or 1
        return [*packed(files, self.most, self.cost), *(Folders(sorted(folders)[k : k + each]) for k in range(0, len(folders), each))] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = open_folder(self.address)
        for entries in [partition.entries] if isinstance(partition, Files) else (self._listed(system, f)[0] for f in partition.folders):
            for e in entries:
                with system.open_input_stream(e.path, compression=None) as f:
                    data = f.read()
                yield e.path, e.extension, len(data), data


class TextCorpusWriter(DataSourceWriter):
    def __init__(self, address: str) -> None:
        self.address = address

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = open_folder(self.address)
        n, made = 0, set()
        for row in rows:
            path = posixpath.normpath(posixpath.join(root, row["path"]))
            if not path.startswith(root.rstrip("/") + "/"):
                raise ValueError(f"outside the folder: {row['path']}")
            folder, name = posixpath.split(path)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own, compression=None) as f:
                f.write(bytes(row["content"] or b""))
            system.move(own, path)
            n += 1
        return Written(n)


class TextCorpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TextCorpusReader:
        return TextCorpusReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TextCorpusWriter:
        if overwrite:
            raise ValueError("text_corpus appends files; remove the folder to begin anew")
        return TextCorpusWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions reach its listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextCorpus)


def decoded(files: DataFrame) -> DataFrame:
    """path, extension, text, encoding, assumed, warning of files read with this format."""
    t = with_decoded(files, "content")
    return t.select("path", "extension", "length", "text", "encoding", "assumed", encoding_warning(F.col("encoding"), F.col("assumed")).alias("warning"))
