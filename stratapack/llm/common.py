"""Small pieces the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapack.session import ship_code

#: Rows of one Arrow batch that goes to a Python worker, and bytes of text worked on at once there.
ROWS_A_BATCH = 5000
BATCH_BYTES = 8 << 20
SLICE_BYTES = 8 << 20


def start(spark: SparkSession) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about `most` bytes of text, one row at least."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column(text)
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def strings(col: pa.Array) -> pa.Array:
    """Nulls become empty strings; the array starts at offset 0 of its own buffers."""
    return pa.concat_arrays([pc.fill_null(col.cast(pa.string()), "")])


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: each word's row, the distinct words, each word's index among them."""
    lists = pc.ascii_split_whitespace(texts)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    rows, flat = rows[full.to_numpy(zero_copy_only=False)], flat.filter(full)
    coded = flat.dictionary_encode()
    return rows, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers; one more entry for the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
