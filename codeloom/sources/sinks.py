"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(lines: DataFrame, path: str) -> None:
    """Write report lines as text, in report order.

    The sort is a range partitioning, so part files in name order hold the
    whole report without one task seeing all of it.
    """
    ordered = lines.orderBy("project", "section", "path", "seq")
    ordered.select("line").write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Write JSON documents, one per line, below one folder per project."""
    documents.select("project", "json").write.mode("overwrite").partitionBy("project").text(path)


def write_tree(files: DataFrame, root: str) -> None:
    """Each row of path and content as a file below `root`, a shared folder or the URI of a store.

    A task that runs again writes the same files again. Of two rows of one path
    either may stay.
    """
    uri = (root if "://" in root else f"file://{root}").rstrip("/")

    def written(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}", compression=None) as file:
                    file.write(content.encode("utf-8"))
            yield batch[["path"]]

    files.select("path", "content").mapInPandas(written, "path string").write.format("noop").mode("overwrite").save()
