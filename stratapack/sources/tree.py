"""A file tree as a data source: every file and directory, hidden and empty ones included.

spark.dataSource.register(TreeSource); spark.read.format("file_tree").load(root) gives path, kind, size,
mtime_ns, attrs, content. Paths are relative with forward slashes, the root itself is "."; a single
file is listed under its own name. Symbolic links aren't followed unless asked, and then each real
directory is entered once. What can't be taken is listed by kind "skipped" (or is an error, with
onError=fail). Content is read by the tasks, one per batch of files.

Options: includeHidden (true), followLinks (false), maxDepth (128), onError (skip | fail), filesPerTask (256).
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratapack.functions.classify import ascii_lower

SCHEMA = "path string, kind string, size long, mtime_ns long, attrs long, content binary, reason string"
HIDDEN = 2


class _Batch(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        flag = lambda name, default: options.get(name.lower(), default).lower() == "true"
        self.root = options["path"]
        self.hidden, self.follow = flag("includeHidden", "true"), flag("followLinks", "false")
        self.depth, self.fail = int(options.get("maxdepth", "128")), options.get("onerror", "skip") == "fail"
        self.per_task = int(options.get("filespertask", "256"))

    def partitions(self) -> list[_Batch]:
        rows = list(self.walk())
        return [_Batch(rows[i : i + self.per_task]) for i in range(0, len(rows), self.per_task)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for path, kind, size, mtime, attrs, real, reason in partition.rows:
            content = None
            if kind == "file":
                with open(real, "rb") as f:
                    content = f.read()
                if len(content) != size:
                    raise OSError(f"short read: {path}")
            yield path, kind, size, mtime, attrs, content, reason

    def _row(self, path: str, kind: str, real: str, reason: str | None = None) -> tuple:
        s = os.lstat(real)
        attrs = HIDDEN if os.path.basename(path).startswith(".") and path != "." else 0
        return path, kind, s.st_size if kind == "file" else 0, s.st_mtime_ns, attrs, real, reason

    def walk(self) -> Iterator[tuple]:
        if os.path.isfile(self.root):
            yield self._row(os.path.basename(self.root), "file", self.root)
            return
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        yield self._row(".", "directory", self.root)
        yield from self._inside(self.root, "", 1, {os.path.realpath(self.root)})

    def _inside(self, real: str, path: str, depth: int, seen: set[str]) -> Iterator[tuple]:
        if depth > self.depth:
            raise ValueError(f"deeper than {self.depth}: {path}")
        try:
            names = sorted(os.listdir(real))
        except PermissionError as e:
            if self.fail:
                raise
            yield self._row(path or ".", "skipped", real, str(e))
            return
        for name in names:
            if not self.hidden and name.startswith("."):
                continue
            here, there = os.path.join(real, name), f"{path}/{name}" if path else name
            mode = (os.stat if self.follow and os.path.exists(here) else os.lstat)(here).st_mode
            if stat.S_ISDIR(mode):
                target = os.path.realpath(here)
                if target in seen:
                    yield self._row(there, "skipped", here, "cycle")
                    continue
                yield self._row(there, "directory", here)
                yield from self._inside(here, there, depth + 1, seen | {target})
            elif stat.S_ISREG(mode):
                if os.access(here, os.R_OK):
                    yield self._row(there, "file", here)
                elif self.fail:
                    raise PermissionError(here)
                else:
                    yield self._row(there, "skipped", here, "unreadable")
            else:
                yield self._row(there, "skipped", here, "not a regular file")


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def canonical_order(path: str = "path", kind: str = "kind") -> list[Column]:
    """Order of a tree's entries: path with A-Z in lower case, then the path itself, then kind."""
    return [ascii_lower(F.col(path)), F.col(path), F.col(kind)]


def escapes(path: Column) -> Column:
    """Whether an archive path would leave the destination: absolute, with a drive or root, or through "..". """
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)") | (path == "")


def split_skipped(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tree.where("kind <> 'skipped'").drop("reason"), tree.where("kind = 'skipped'").select("path", "reason")
