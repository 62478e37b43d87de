"""Content-defined chunking: a rolling value over the current chunk, reset at every cut."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from stratapack.functions.classify import CHUNK_OVER

MIN_CHUNK, MAX_CHUNK, CUT_MASK = 8_192, 65_536, 0x3FFF
GEAR_SEED = 17


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks: at a cut value of 0 from MIN_CHUNK on, at MAX_CHUNK latest.

    The value is (33 * h) ^ byte from 0 at the chunk's start. Its low 14 bits depend on its low 14 bits
    only, so no wider arithmetic is needed to find the cuts.
    """
    n = len(data)
    if n <= CHUNK_OVER:
        return [n]
    out, start = [], 0
    while start < n:
        stop, warm = min(start + MAX_CHUNK, n), min(start + MIN_CHUNK, n) - 1
        h = 0
        for b in data[start:warm]:
            h = (h * 33 & CUT_MASK) ^ b
        end = stop
        for i in range(warm, stop):
            h = (h * 33 & CUT_MASK) ^ data[i]
            if not h:
                end = i + 1
                break
        out.append(end)
        start = end
    return out


def gear_cut_points(data: bytes, low: int = MIN_CHUNK, high: int = MAX_CHUNK, mask: int = 0x3FFF << 40) -> list[int]:
    """FastCDC's windowed gear hash (Xia et al. 2016): cuts line up again after an edit. An extra to cut_points()."""
    n = len(data)
    if n <= low:
        return [n]
    gear = np.random.default_rng(GEAR_SEED).integers(0, 1 << 63, 256, np.uint64)
    values = gear[np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):  # h_i = sum of g_{i-k} << k over the last 64 bytes
        h = values.copy()
        for k in range(1, 64):
            h[k:] += values[:-k] << np.uint64(k)
    cuts = np.flatnonzero((h & np.uint64(mask)) == 0) + 1
    out, start = [], 0
    while start < n:
        i = np.searchsorted(cuts, start + low)
        end = min(start + high, n, int(cuts[i]) if i < len(cuts) else n)
        out.append(end)
        start = end
    return out


def chunk_files(files: DataFrame, gear: bool = False) -> DataFrame:
    """file_id, chunk_idx, offset, size, digest, data of every file's chunks, in one map."""
    cut = gear_cut_points if gear else cut_points

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("content")[i].as_py() or b""
                ends = cut(data)
                starts = [0, *ends[:-1]]
                parts = [data[x:y] for x, y in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "file_id": pa.array([b.column("file_id")[i].as_py()] * len(parts), pa.int64()), "chunk_idx": pa.array(range(len(parts)), pa.int32()),
                    "offset": pa.array(starts, pa.int64()), "size": pa.array([len(p) for p in parts], pa.int64()),
                    "digest": pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()), "data": pa.array(parts, pa.binary()),
                })

    return files.select("file_id", "content").mapInArrow(run, "file_id long, chunk_idx int, offset long, size long, digest string, data binary")


@udtf(returnType="chunk_idx int, offset long, size long")
class ChunkBounds:
    """The same cuts as a table function over one content, for SQL with LATERAL."""

    def eval(self, content: bytes):
        start = 0
        for i, end in enumerate(cut_points(bytes(content or b""))):
            yield i, start, end - start
            start = end
