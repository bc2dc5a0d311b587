"""Source trees on a file system or in a store, read as one row per file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators.files import in_repository_data, is_binary_name
from codeloom.session import cut_lineage

BATCH_BYTES = 32 * 1024 * 1024
LISTED = "path string, size long, folder boolean, error string"
READ = "path string, size long, text string, error string"


def scan_tree(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None,
              binaries: bool = False, failures: bool = False) -> DataFrame:
    """Read every file below `root`; the first directory is the project.

    Links to directories are not followed, so no cycle is. What cannot be listed
    or read is left out; with `failures` it comes as a row with a null content and
    the reason in `error`, a column that is null for all others.

    `root` is a folder all executors mount, or the URI of a store that the
    installed Arrow file systems reach (s3, gs, abfss, hdfs, file). Names that
    start with `_` or `.` are read like all others. Files are dropped before they
    are opened: by `glob`, above `max_bytes`, and, unless `binaries`, by a binary
    extension or a place in repository data. Text is UTF-8 with undecodable
    bytes left out and line ends unified.
    """
    uri = root if "://" in root else f"file://{root}"
    found = _listing(spark, uri.rstrip("/"))
    path = F.col("path")
    found = found.withColumn("ext", paths.extension(path))
    if max_bytes is not None:
        found = found.filter(F.col("size") <= max_bytes)
    if glob:
        found = found.filter(path.rlike(paths.glob_regex(glob)))
    if not binaries:
        found = found.filter(~is_binary_name(F.col("ext")) & ~in_repository_data(path))
    listed = F.col("error").isNull()
    texts = _read(found.filter(listed).select("path", "size"), uri.rstrip("/"))
    if failures:
        texts = texts.unionByName(found.filter(~listed).select("path", "size", F.lit(None).cast("string").alias("text"), "error"))
    else:
        texts = texts.filter(listed)
    return texts.select(
        F.regexp_extract(path, r"^([^/]*)/", 1).alias("project"), "path", paths.extension(path).alias("ext"), "size",
        F.regexp_replace("text", r"\r\n?", "\n").alias("content"), *(["error"] if failures else []),
    )


def _listing(spark: SparkSession, uri: str) -> DataFrame:
    """All files below a root, with their size.

    Directories are listed level by level: those of one level are dealt out
    over the tasks, so one project with most of the directories is spread.
    There are as many rounds as the tree is deep.
    """
    def listed(batches):
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        local = system.type_name == "local"

        def entries(folder):
            start = f"{base}/{folder}".rstrip("/")
            try:
                infos = system.get_file_info(fs.FileSelector(start, recursive=False))
            except OSError as problem:
                if not folder:
                    raise  # there is no such tree
                return [(folder, 0, False, str(problem))]
            found = []
            for info in infos:
                is_folder = info.type == fs.FileType.Directory
                if is_folder and local and os.path.islink(info.path):
                    continue
                found.append((info.path[len(base):].lstrip("/"), info.size or 0, is_folder, None))
            return found

        for batch in batches:
            for folder in batch["path"]:
                if found := entries(folder):
                    yield pd.DataFrame(found, columns=["path", "size", "folder", "error"])

    files = spark.createDataFrame([], "path string, size long, error string")
    level = spark.createDataFrame([("",)], "path string")
    while True:
        found = cut_lineage(level.repartition("path").mapInPandas(listed, LISTED), "listing")
        files = files.unionByName(found.filter(~F.col("folder")).select("path", "size", "error"))
        level = found.filter("folder").select("path")
        if level.isEmpty():
            return files


def _read(found: DataFrame, uri: str) -> DataFrame:
    """Contents of the listed files; the list is dealt out by path, so one huge project is spread."""
    def read(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)

        def text_of(path):
            try:
                with system.open_input_stream(f"{base}/{path}") as file:
                    return file.read().decode("utf-8", "ignore"), None
            except OSError as problem:
                return None, str(problem)

        for batch in batches:
            rows, held = [], 0
            for path, size in zip(batch["path"], batch["size"]):
                rows.append((path, size, *text_of(path)))
                held += size
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "size", "text", "error"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "size", "text", "error"])

    return found.repartition("path").mapInPandas(read, READ)
