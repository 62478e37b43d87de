"""Writing restored files, each through a temporary sibling that is renamed when it is whole."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapack.sources.tree import escapes


def free_name(folder: str, name: str, most: int = 999) -> str:
    """name, or "name (2)" and so on before its suffix, whichever isn't taken."""
    stem, dot, suffix = name.rpartition(".")
    stem, suffix = (stem, dot + suffix) if stem else (name, "")
    for i in range(1, most + 1):
        out = os.path.join(folder, name if i == 1 else f"{stem} ({i}){suffix}")
        if not os.path.exists(out):
            return out
    raise FileExistsError(name)


class AtomicFile:
    """with AtomicFile(path) as f: ... - the file appears whole or not at all."""

    def __init__(self, path: str):
        self.path, self.temp = path, f"{path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self.file = open(self.temp, "wb")  # noqa: SIM115
        return self.file

    def __exit__(self, kind, value, trace):
        self.file.close()
        if kind is None:
            os.replace(self.temp, self.path)
        else:
            os.unlink(self.temp)


def extract_to(files: DataFrame, destination: str) -> int:
    """Write path, kind, content (and mtime_ns, if there) below a folder that all workers share; the number written.

    Every path is checked before anything is written.
    """
    bad = files.where(escapes(F.col("path"))).select("path").first()
    if bad is not None:
        raise ValueError(f"path leaves the destination: {bad['path']}")
    times = "mtime_ns" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                to = destination if r["path"] == "." else os.path.join(destination, r["path"])
                os.makedirs(to if r["kind"] == "directory" else os.path.dirname(to), exist_ok=True)
                if r["kind"] != "directory":
                    with AtomicFile(to) as f:
                        f.write(r["content"] or b"")
                    if times and r["mtime_ns"] is not None:
                        os.utime(to, ns=(r["mtime_ns"], r["mtime_ns"]))
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    keep = ["path", "kind", "content"] + ["mtime_ns"] * times
    return files.select(*keep).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
