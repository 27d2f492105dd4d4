"""S1 as a Python data source: a tree of files, of which only folders that are not ignored are entered, and only source files opened.

The driver lists the upper folders until there are enough of them to deal out; each of these is a partition, walked by its task. The files of
a folder that the driver lists are dealt over several tasks by their names, at most ``tasks`` (an option): each of these lists the folder and opens
its share. Local folders are listed name by name, so that neither the driver nor a task holds a large one. Ignore
files (``.gitignore``) are read on the way and hold below their folder. Filters on ``path`` (equality, lists, beginnings, ends) are taken
with the option ``pushdown``, which goes with ``spark.sql.python.filterPushdown.enabled``, and spare folders and files.

Defined results: bytes that are not UTF-8 become U+FFFD; a file of over MOST_BYTES has a null content, but its size and hash; an empty
folder gives no rows. The tree is reached through Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from tracelake.functions import globs

SCHEMA = "repo_id string, path string, content string, mtime double, size long, sha256 string"
SOURCE = re.compile(r"\.(ts|tsx|js|jsx|py)$", re.I)
MOST_BYTES, BATCH_BYTES, CHUNK, FOLDERS, SHARE = 1 << 30, 4 << 20, 1 << 22, 64, 1 << 12
IGNORE_FILE = ".gitignore"


@dataclass
class Folder(InputPartition):
    """A folder, whether what lies below it belongs to it, the ignore patterns that hold there, and which share of its files is meant."""

    path: str
    deep: bool
    patterns: tuple[str, ...]
    share: int = 0
    shares: int = 1  # none: no files

    def holds(self, name: str) -> bool:
        return self.shares == 1 or self.shares > 1 and zlib.crc32(os.fsencode(name)) % self.shares == self.share


def rules_of(text: str, folder: str) -> tuple[str, ...]:
    """The patterns of an ignore file: lines without comments, blank and negated ones, below its folder."""
    lines = [x.strip() for x in text.splitlines()]
    own = [x.strip("/") for x in lines if x and x[0] not in "#!"]
    return tuple(f"{folder}/{x}" if folder else x for x in own)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo = re.sub(r"^file:/+", "file:///", options["path"]), options.get("repo_id", "")
        self.folders = frozenset(json.loads(options.get("folders", json.dumps(globs.IGNORED_FOLDERS))))
        self.patterns = tuple(json.loads(options.get("patterns", json.dumps(globs.IGNORED_PATTERNS))))
        self.tasks = max(1, int(options.get("tasks", FOLDERS)))
        self.wanted: list[Filter] = []

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.root)
        return store, base.rstrip("/")

    def _may_hold(self, folder: str) -> bool:
        """Whether files below the folder can pass the filters."""
        inside = lambda path: not folder or path.startswith(f"{folder}/")
        for x in self.wanted:
            if isinstance(x, StringStartsWith) and not (inside(x.value) or f"{folder}/".startswith(x.value)):
                return False
            if isinstance(x, EqualTo) and not inside(x.value) or isinstance(x, In) and not any(inside(v) for v in x.value if v):
                return False
        return True

    def _passes(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith}
        return SOURCE.search(path) is not None and all(tests[type(x)](x.value) for x in self.wanted)

    def _list(self, store: fs.FileSystem, base: str, folder: Folder) -> Iterator[tuple[Folder | str, fs.FileInfo | None]]:
        """The folders in a folder to enter, and the paths of its files to open (of its share), as they are found; F2 leaves out the others."""
        at = f"{base}/{folder.path}".rstrip("/")
        patterns, rules = folder.patterns, store.get_file_info(f"{at}/{IGNORE_FILE}")
        if rules.is_file:
            with store.open_input_stream(rules.path) as file:
                patterns += rules_of(file.read().decode("utf-8", "replace"), folder.path)
        matches = globs.matcher(patterns)
        ignored = lambda path, name: name in self.folders or matches(path, [name])  # noqa: E731  (the folder itself was tested before)
        for name, is_folder, info in _entries(store, at):
            if not (folder.deep if is_folder else folder.holds(name)):
                continue
            path = f"{folder.path}/{name}" if folder.path else name
            if is_folder and self._may_hold(path) and not ignored(path, name):
                yield Folder(path, True, patterns), None
            elif not is_folder and self._passes(path) and not ignored(path, name):
                yield path, info

    def partitions(self) -> list[Folder]:
        store, base = self._store()
        level, done = [Folder("", True, self.patterns)], []
        while level and len(level) + len(done) < FOLDERS:
            below: list[Folder] = []
            for x in level:
                files = 0
                for found, _ in self._list(store, base, x):
                    if isinstance(found, Folder):
                        below.append(found)
                    else:
                        files += 1
                        if files == SHARE * self.tasks:  # enough for all tasks: from here on only folders are looked for
                            x.shares = 0
                shares = min(-(-files // SHARE), self.tasks)
                done += [Folder(x.path, False, x.patterns, k, shares) for k in range(shares)]
            level = sorted(below, key=lambda x: x.path)
        return done + level

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        waiting, rows, size = [partition], [], 0
        while waiting:
            found = list(self._list(store, base, waiting.pop()))
            waiting += sorted((x for x, _ in found if isinstance(x, Folder)), key=lambda x: x.path, reverse=True)
            for path, info in sorted((x for x in found if not isinstance(x[0], Folder)), key=lambda x: x[0]):
                info = info or store.get_file_info(f"{base}/{path}")
                if not info.is_file:
                    continue
                row = self._open(store, path, info)
                if rows and size + len(row[2] or "") > BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2] or "")
        if rows:
            yield _batch(rows)

    def _open(self, store: fs.FileSystem, path: str, info: fs.FileInfo) -> tuple:
        digest, parts = hashlib.sha256(), []
        with store.open_input_stream(info.path) as file:
            while part := file.read(CHUNK):
                digest.update(part)
                parts += [part] if info.size <= MOST_BYTES else []
        content = b"".join(parts).decode("utf-8", "replace") if info.size <= MOST_BYTES else None
        return self.repo, path, content, info.mtime.timestamp(), info.size, digest.hexdigest()


class PushingReader(Reader):
    """The reader where Spark hands filters down; it refuses readers that take them elsewhere."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take filters on the path; Spark looks at all of them once more."""
        self.wanted = [x for x in filters if isinstance(x, (EqualTo, In, StringStartsWith, StringEndsWith)) and x.attribute == ("path",)]
        yield from filters


def _entries(store: fs.FileSystem, at: str) -> Iterator[tuple[str, bool, fs.FileInfo | None]]:
    """Names in a folder, and whether they are folders. Arrow lists a folder whole and asks for each file; local ones are gone through name by name."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for x in found:
                yield x.name, x.is_dir(), None
    else:
        for x in store.get_file_info(fs.FileSelector(at)):
            yield x.base_name, x.type == fs.FileType.Directory, x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        options = dict(self.options)
        return (PushingReader if options.get("pushdown") == "true" else Reader)(options)
