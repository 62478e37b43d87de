"""Session helpers shared by every operator: code shipping and shared scratch space."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Nothing to do where PYTHONPATH already carries it to the workers; otherwise the package goes out
    once per application through addPyFile, which serves it to executors that join later too.
    """
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p]
    app = spark.sparkContext.applicationId
    if str(_ROOT) in on_path or app in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp()) / "stratapack.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "stratapack").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where unset in local mode, one of our own."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _own_dir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="stratapack-"))
    return _OWN[0]


def materialize(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/stratapack-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    _remove(spark, df._scratch, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours when the driver exits."""
    atexit.register(_remove, spark, path, False)


def _remove(spark: SparkSession, path: str, with_parent: bool) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent() if with_parent else p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already at exit
        return
