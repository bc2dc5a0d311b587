"""Source trees as a data source of Spark's own: `spark.read.format("source_tree")`.

    register(spark)
    spark.read.format("source_tree").load("/mnt/repos").filter("ext = '.py' AND size < 100000")
    spark.readStream.format("source_tree").load("/mnt/repos")

Rows are those of `scan_tree` with `failures`: project, path, ext, size, content,
error. Comparisons of `project`, `ext` and `size` with values are pushed down:
other projects are not listed, other files not opened.

A partition is a stretch of the tree in order of path, of about
`partitionBytes`. The planning side goes through the names once and keeps the
two ends of each stretch, never the names; a task lists its own stretch again
and enters no folder outside of it. What appears in between is read by the task
in whose stretch it falls. `scan_tree` lists in tasks too, for trees so large
that going through the names at one place takes too long.

The stream gives each file once, by the time it was last changed, and a changed
file again. Files are given when they have been left alone for `settleSeconds`
(10 unless given), so that half-written ones are not; a file that is put in
place with an older time than that is missed. There is no state beside the
offset, a time.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from codeloom import settings

NAME = "source_tree"
SCHEMA = "project string, path string, ext string, size long, content string, error string"
BATCH_BYTES = 32 * 1024 * 1024
PARTITION_BYTES = 64 * 1024 * 1024
OPEN_BYTES = 64 * 1024  # what opening a file costs, in bytes read
ARROW = pa.schema([
    ("project", pa.string()), ("path", pa.string()), ("ext", pa.string()), ("size", pa.int64()),
    ("content", pa.string()), ("error", pa.string()),
])


def extension_of(path: str) -> str:
    """As `paths.extension`."""
    found = re.search(r"[^./][^/]*?(\.[^./]*)\Z", path)
    return found[1].lower() if found else ""


def project_of(path: str) -> str:
    return path.partition("/")[0] if "/" in path else ""


@dataclass
class Wanted:
    """The pushed comparisons; a value must pass all of them."""

    projects: list[set] = field(default_factory=list)
    exts: list[set] = field(default_factory=list)
    sizes: list[tuple[str, int]] = field(default_factory=list)

    SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}

    def take(self, given: ds.Filter) -> bool:
        """Whether the filter is applied here; all others are left to Spark."""
        name = ".".join(given.attribute) if hasattr(given, "attribute") else ""
        if isinstance(given, ds.IsNotNull):
            return name in ("project", "path", "ext", "size")
        if name == "size" and type(given) in self.SIGNS:
            self.sizes.append((self.SIGNS[type(given)], given.value))
            return True
        if name in ("project", "ext") and isinstance(given, (ds.EqualTo, ds.In)):
            values = {given.value} if isinstance(given, ds.EqualTo) else set(given.value)
            (self.projects if name == "project" else self.exts).append(values)
            return True
        return False

    def project(self, name: str) -> bool:
        return all(name in values for values in self.projects)

    def file(self, path: str, size: int) -> bool:
        ext = extension_of(path)
        passes = {"=": size.__eq__, ">": size.__gt__, ">=": size.__ge__, "<": size.__lt__, "<=": size.__le__}
        return (self.project(project_of(path)) and all(ext in values for values in self.exts)
                and all(passes[sign](value) for sign, value in self.sizes))


@dataclass
class Stretch(ds.InputPartition):
    """Paths from `first` to `last`, both as lists of names, changed in `since` < time <= `upto` where given."""

    first: list[str] | None = None
    last: list[str] | None = None
    since: int | None = None
    upto: int | None = None


@dataclass
class Found:
    path: str
    size: int
    changed: int
    error: str | None = None


class Tree:
    """Walks below a root in order of path, one folder at a time."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("load() needs the root of the tree")
        root = options["path"]
        self.uri = (root if "://" in root else f"file://{root}").rstrip("/")
        self.binaries = str(options.get("binaries", "false")).lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.settle = float(options.get("settleseconds", 10))

    def walk(self, wanted: Wanted, part: Stretch) -> Iterator[Found]:
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.uri)
        local = system.type_name == "local"
        first, last = part.first or [], part.last

        def inside(names):
            """Whether the path, or something below it, lies in the stretch."""
            return names >= first[:len(names)] and (last is None or names <= last[:len(names)])

        ahead = [([], None)]
        while ahead:
            names, info = ahead.pop()
            path = "/".join(names)
            if info is not None and info.type != fs.FileType.Directory:
                found = Found(path, info.size or 0, info.mtime_ns or 0)
            else:
                try:
                    entries = system.get_file_info(fs.FileSelector(f"{base}/{path}".rstrip("/"), recursive=False))
                except OSError as problem:
                    if not names:
                        raise  # there is no such tree
                    found = Found(path, 0, info.mtime_ns or 0, str(problem))
                else:
                    below = []
                    for entry in entries:
                        at = [*names, entry.base_name]
                        folder = entry.type == fs.FileType.Directory
                        if not inside(at) or folder and local and os.path.islink(entry.path):
                            continue
                        if folder and not names and not wanted.project(entry.base_name):
                            continue
                        if folder and entry.base_name == ".git" and not self.binaries:
                            continue
                        below.append((at, entry))
                    ahead += sorted(below, key=lambda b: b[0], reverse=True)
                    continue
            if not self.binaries and extension_of(path) in settings.BINARY_EXTENSIONS:
                continue
            if part.since is not None and not part.since < found.changed <= part.upto:
                continue
            if wanted.file(path, found.size):
                yield found

    def stretches(self, wanted: Wanted, window: Stretch) -> list[Stretch]:
        parts, held = [], 0
        for found in self.walk(wanted, window):
            cost = found.size + OPEN_BYTES
            names = found.path.split("/")
            if not parts or held + cost > self.partition_bytes:
                parts.append(Stretch(names, names, window.since, window.upto))
                held = 0
            parts[-1].last = names
            held += cost
        for part in parts:
            part.value = (part.first, part.last)
        return parts

    def rows(self, wanted: Wanted, part: Stretch) -> Iterator[pa.RecordBatch]:
        """Contents in batches of bounded bytes."""
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.uri)

        def content(found):
            if found.error:
                return None, found.error
            try:
                with system.open_input_stream(f"{base}/{found.path}", compression=None) as file:
                    text = file.read().decode("utf-8", "ignore")
            except OSError as problem:
                return None, str(problem)
            return text.replace("\r\n", "\n").replace("\r", "\n"), None

        def batch(rows):
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)

        rows, held = [], 0
        for found in self.walk(wanted, part):
            if rows and held + found.size > BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
            rows.append((project_of(found.path), found.path, extension_of(found.path), found.size, *content(found)))
            held += found.size + 1024
        if rows:
            yield batch(rows)


class TreeReader(ds.DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree, self.wanted = tree, Wanted()

    def pushFilters(self, filters):
        return [given for given in filters if not self.wanted.take(given)]

    def partitions(self):
        nothing = Stretch(last=[])  # Spark asks for one at least
        return self.tree.stretches(self.wanted, Stretch()) or [nothing]

    def read(self, partition):
        return self.tree.rows(self.wanted, partition)


class TreeStream(ds.DataSourceStreamReader):
    def __init__(self, tree: Tree):
        self.tree, self.wanted = tree, Wanted()

    def initialOffset(self):
        return {"upto": -1}

    def latestOffset(self):
        """The latest change that has settled; unchanged as long as nothing new has."""
        settled = time.time_ns() - int(self.tree.settle * 1e9)
        changes = (f.changed for f in self.tree.walk(self.wanted, Stretch(since=-1, upto=settled)))
        return {"upto": max(changes, default=-1)}

    def partitions(self, start, end):
        return self.tree.stretches(self.wanted, Stretch(since=start["upto"], upto=end["upto"]))

    def read(self, partition):
        return self.tree.rows(self.wanted, partition)


class SourceTree(ds.DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(Tree(self.options))

    def streamReader(self, schema):
        return TreeStream(Tree(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
