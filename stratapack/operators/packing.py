"""Similarity ordering and solid packing, on metadata and histograms only.

Within an extension, items are ordered by a greedy chain of most similar histograms, then packed into
groups up to a cap. Both are sequential folds, so they run in Python per group; a group's rows are
metadata of bounded size: extension runs are cut into segments of at most MAX_RUN items by path
order first (longer runs keep path order in the original semantics), and payloads never travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from stratapack.operators.ordering import running_totals

MAX_RUN = 4096
SAMPLE_BYTES = 65_536
CAPS = {"compressible": 512 << 20, "executable": 128 << 20}


def _counts(data) -> np.ndarray:
    """Byte counts, strided over long contents."""
    buf = np.frombuffer(bytes(data or b""), np.uint8)
    if len(buf) > SAMPLE_BYTES:
        buf = buf[:: len(buf) // SAMPLE_BYTES]
    return np.bincount(buf, minlength=256)


def _normalised(n: np.ndarray) -> np.ndarray:
    h = n.astype(float)
    norm = np.sqrt((h * h).sum())
    return (h / norm if norm else h).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def fingerprint(content: pd.Series) -> pd.Series:
    """The L2-normalised byte histogram, strided over long contents; zeros for an empty one."""
    return content.map(lambda data: _normalised(_counts(data)))


def sparse_histogram(data: bytes) -> bytes:
    """The counts that fingerprint() normalises, of the bytes that occur: byte values, then counts of four bytes."""
    n = _counts(data)
    at = np.flatnonzero(n)
    return at.astype(np.uint8).tobytes() + n[at].astype("<u4").tobytes()


def dense(rows: pd.Series) -> np.ndarray:
    """A row of 256 for each fingerprint, whether dense or a sparse histogram."""
    if not isinstance(rows.iloc[0], (bytes, bytearray)):
        return np.stack(rows.to_numpy()).astype(np.float32)
    out = np.zeros((len(rows), 256), np.float32)
    for i, data in enumerate(rows):
        k, n = len(data) // 5, np.zeros(256, np.int64)
        n[np.frombuffer(data, np.uint8, k)] = np.frombuffer(data, "<u4", k, k)
        out[i] = _normalised(n)
    return out


def byte_histogram(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """Byte counts per group, as rows: keys, byte, n. Each batch is counted before anything is shuffled."""
    picked = rows.select(*keys, content.alias("_content")).where("_content IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for _, g in pdf.groupby(keys, dropna=False, sort=False):
                n = np.bincount(np.frombuffer(b"".join(map(bytes, g["_content"])), np.uint8), minlength=256)
                at = np.flatnonzero(n)
                parts.append(pd.DataFrame({**{k: [g[k].iloc[0]] * len(at) for k in keys}, "byte": at, "n": n[at]}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    schema = StructType([*picked.select(*keys).schema.fields, StructField("byte", LongType()), StructField("n", LongType())])
    return picked.mapInPandas(count, schema).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def entropy(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Bits per byte of each group's histogram."""
    totals = histogram.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    return totals.select(*keys, F.col("total").cast("long").alias("total"), (F.log2("total") - F.col("w") / F.col("total")).alias("entropy"))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of two normalised vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def chain(h: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Greedy nearest-neighbour order: the largest first, then the most similar left, the earlier on ties."""
    n = len(h)
    if n <= 2 or n > MAX_RUN:
        return list(range(n))
    near, taken, at, out = h @ h.T, np.zeros(n, np.float32), int(np.argmax(sizes)), []  # MAX_RUN bounds it to 64 MiB
    for _ in range(n):
        out.append(at)
        taken[at] = -np.inf
        at = int(np.argmax(near[at] + taken))
    return out


def runs(items: DataFrame, segment: str) -> DataFrame:
    """item_id, the segment, position and run_no: runs of MAX_RUN items of one segment by path.

    One range sort over ids and paths, so a segment that holds most items still spreads over many tasks.
    """
    ids = items.select("item_id", segment, "path")
    ranked = running_totals(items.sparkSession, ids, [F.col(segment), F.col("path"), F.col("item_id")])
    first = ranked.groupBy(segment).agg(F.min("position").alias("first"))
    ranked = ranked.alias("r").join(first.alias("f"), F.col(f"r.{segment}").eqNullSafe(F.col(f"f.{segment}")))
    place = F.col("r.position") - F.col("f.first")
    return ranked.select("r.item_id", f"r.{segment}", place.alias("place"), F.floor(place / MAX_RUN).cast("long").alias("run_no"))


def similarity_order(items: DataFrame) -> DataFrame:
    """item_id, ext, run_no, position: order within the run of one extension (case-sensitive)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["path", "item_id"], ignore_index=True)
        order = chain(dense(pdf["fingerprint"]), pdf["size"].to_numpy())
        out = pdf.iloc[order][["item_id", "ext", "run_no"]]
        return out.assign(position=np.arange(len(out), dtype=np.int64))

    cut = runs(items, "ext").join(items.drop("ext"), "item_id")
    return cut.select("item_id", "ext", "run_no", "path", "size", "fingerprint").groupBy("ext", "run_no").applyInPandas(run, "item_id string, ext string, run_no long, position long")


def pack(items: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """item_id, segment, group_in_segment and the offsets in both address spaces.

    items: item_id, segment, position, bucket, size, fallback_size, raw. Raw items and those of the cap's
    size or more stand alone; a change of bucket, or a sum over the cap, begins a new group.
    """
    caps = caps or CAPS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", ignore_index=True)
        group, filled, back, bucket, rows = -1, 0, 0, None, []
        for r in pdf.itertuples():
            cap = caps[r.bucket]
            alone = bool(r.raw) or r.size >= cap
            if alone or bucket != r.bucket or filled + r.size > cap:
                group, filled, back = group + 1, 0, 0
            rows.append((r.item_id, r.segment, group, filled, back))
            filled, back = filled + r.size, back + r.fallback_size
            bucket = None if alone else r.bucket
        return pd.DataFrame(rows, columns=["item_id", "segment", "group_in_segment", "payload_offset", "fallback_offset"])

    return items.groupBy("segment").applyInPandas(run, "item_id string, segment string, group_in_segment long, payload_offset long, fallback_offset long")
