"""Source trees as a Spark data source, `source_tree`: a pruned walk that the executors share.

Planning lists folders from the roots down, and leaves out those that no extractor enters,
until there are enough of them to deal out; a partition is some of these folders, walked to their
end by its task, or some files met on the way. Only files of wanted names are opened, and their contents go out in
Arrow batches of bounded size. Filters on `name` (equal, in, ends with) and on the beginning of `rel` are taken over
from queries, so that files that they exclude are not opened and folders are not entered.

Folders are on any storage that pyarrow reads: paths that all hosts see, s3://, gs://, hdfs://.
Names that begin with a dot or an underscore are files like others, unlike in Spark's own file sources.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith

from lodegraph.sources.pruning import FILES, READS, Pruning

_ARROW = pa.schema([("root", pa.string()), ("root_ord", pa.int32()), ("path", pa.string()), ("rel", pa.string()), ("name", pa.string()), ("content", pa.binary())])


def _is_remote(root: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", root) is not None and not root.startswith("file://")


@dataclass(frozen=True)
class Storage:
    """Where a root lies: a local path, or a path on one of pyarrow's file systems. Links to folders aren't followed."""

    root: str

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    @staticmethod
    def local(root: str) -> str:
        return root.removeprefix("file://")

    def exists(self) -> bool:
        if not _is_remote(self.root):
            return os.path.isdir(self.local(self.root))
        from pyarrow import fs

        system, base = self._remote()
        return system.get_file_info(base).type == fs.FileType.Directory

    def entries(self, rel: str) -> tuple[list[str], list[str]]:
        """Names of the folders and of the files in the folder `rel` below the root, each in order."""
        folders, files = [], []
        if _is_remote(self.root):
            from pyarrow import fs

            system, base = self._remote()
            for info in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{rel}".rstrip("/"))):
                (folders if info.type == fs.FileType.Directory else files).append(info.base_name)
        else:
            with os.scandir(os.path.join(self.local(self.root), rel)) as found:
                for entry in found:
                    if entry.is_dir():
                        if not entry.is_symlink():
                            folders.append(entry.name)
                    elif entry.is_file():
                        files.append(entry.name)
        return sorted(folders), sorted(files)

    def read(self, rel: str) -> bytes:
        if _is_remote(self.root):
            system, base = self._remote()
            with system.open_input_stream(f"{base.rstrip('/')}/{rel}") as f:
                return f.read()
        with open(os.path.join(self.local(self.root), rel), "rb") as f:
            return f.read()


@dataclass(frozen=True)
class Wanted:
    """What a query's filters leave of files: full names, ends of names, and beginnings of paths below the root."""

    names: tuple[tuple[str, ...], ...] = ()
    ends: tuple[str, ...] = ()
    begins: tuple[str, ...] = ()

    def file(self, name: str, rel: str) -> bool:
        return all(name in some for some in self.names) and all(map(name.endswith, self.ends)) and all(map(rel.startswith, self.begins))

    def folder(self, rel: str) -> bool:
        """Whether a file below the folder can be wanted."""
        return all(f"{rel}/".startswith(b) or b.startswith(f"{rel}/") for b in self.begins)


@dataclass
class _Part(InputPartition):
    """Folders to walk, as (root's number, path below it, extractors that enter), and single files, as (root's number, path)."""

    folders: list[tuple[int, str, tuple[str, ...]]] = field(default_factory=list)
    files: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[tuple[str, str]], extractors: tuple[str, ...], folders: int, batch_bytes: int):
        #: each root as it is named in rows, and where it is
        self.roots, self.folders, self.batch_bytes = roots, folders, batch_bytes
        self.pruning, self.wanted = Pruning(extractors), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names, ends, begins = list(self.wanted.names), list(self.wanted.ends), list(self.wanted.begins)
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                names.append((f.value,))
            elif isinstance(f, In) and f.attribute == ("name",):
                names.append(tuple(f.value))
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                ends.append(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("rel",):
                begins.append(f.value)
            elif not isinstance(f, IsNotNull) or f.attribute not in (("name",), ("rel",)):
                yield f
        self.wanted = Wanted(tuple(names), tuple(ends), tuple(begins))

    def _step(self, k: int, rel: str, live: tuple[str, ...]) -> tuple[list[tuple[int, str, tuple[str, ...]]], list[tuple[int, str]]]:
        """The folders to enter and the files to read in one folder."""
        folders, files = Storage(self.roots[k][1]).entries(rel)
        depth = rel.count("/") + 1 if rel else 0
        under = lambda name: f"{rel}/{name}" if rel else name
        below = [(k, under(f), self.pruning.below(live, f, depth)) for f in folders if self.wanted.folder(under(f))]
        return [b for b in below if b[2]], [(k, under(f)) for f in files if self.wanted.file(f, under(f)) and self.pruning.reads(live, f, depth)]

    def partitions(self) -> list[InputPartition]:
        todo: deque[tuple[int, str, tuple[str, ...]]] = deque()
        for k, (name, root) in enumerate(self.roots):
            if not Storage(root).exists():
                raise FileNotFoundError(f"{name}: no such folder")
            if live := self.pruning.start(name):
                todo.append((k, "", live))
        files: list[tuple[int, str]] = []
        while todo and len(todo) < self.folders:
            folders, found = self._step(*todo.popleft())
            todo += folders
            files += found
        parts = [_Part(folders=[one]) for one in todo]
        parts += [_Part(files=files[at : at + 256]) for at in range(0, len(files), 256)]
        return parts or [_Part()]

    def _paths(self, part: _Part) -> Iterator[tuple[int, str]]:
        yield from part.files
        todo = list(part.folders)
        while todo:
            folders, files = self._step(*todo.pop())
            yield from files
            todo += folders[::-1]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for k, rel in self._paths(partition):
            name, root = self.roots[k]
            content = Storage(root).read(rel)
            rows.append((name, k, rel if name == "." else f"{name.rstrip('/')}/{rel}", rel, rel.rsplit("/", 1)[-1], content))
            held += len(content)
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class SourceTree(DataSource):
    """Options: roots (JSON list, or one path), places (JSON list of where the roots are, if they are named otherwise), extractors (JSON list), folders (how many to plan), batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        given = self.options.get("roots") or self.options["path"]
        roots = json.loads(given) if given.startswith("[") else [given]
        places = json.loads(self.options.get("places", "null")) or roots
        extractors = tuple(json.loads(self.options.get("extractors", "null")) or READS)
        return TreeReader(list(zip(roots, places, strict=True)), extractors, int(self.options.get("folders", "64")), int(self.options.get("batchBytes", str(16 << 20))))


def register(spark: SparkSession) -> None:
    """Makes `source_tree` known to the session, and lets queries hand it their filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)


def read(spark: SparkSession, roots: list[str], extractors: tuple[str, ...], folders: int = 64) -> DataFrame:
    """FILES of the roots. Paths without a scheme are taken from the driver's working folder."""
    register(spark)
    places = [r if "://" in r else os.path.abspath(r) for r in roots]
    options = {"roots": json.dumps(roots), "places": json.dumps(places), "extractors": json.dumps(extractors), "folders": str(folders)}
    return spark.read.format("source_tree").options(**options).load()
