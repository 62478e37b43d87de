"""Digests. sha2 is the default everywhere; the others exist for content that carries them already."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

FNV_PRIME = 1099511628211
FNV_SEED_A = 14695981039346656037
FNV_SEED_B = 1099511628211 * 97 % (1 << 64)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def fold_bytes(contents: list[bytes], start: np.ndarray, step) -> np.ndarray:
    """A byte-by-byte fold of many byte strings at once: one numpy step per position over the rows that reach it."""
    order = sorted(range(len(contents)), key=lambda i: -len(contents[i]))
    lengths = np.array([len(contents[i]) for i in order], np.int64)
    state = start[order].copy() if len(order) else start
    width = 4096
    for at in range(0, int(lengths[0]) if len(lengths) else 0, width):
        live = int(np.searchsorted(-lengths, -at, side="left"))
        block = np.zeros((live, width), np.uint8)
        for r in range(live):
            piece = contents[order[r]][at : at + width]
            block[r, : len(piece)] = np.frombuffer(piece, np.uint8)
        columns = np.ascontiguousarray(block.T)
        for j in range(min(width, int(lengths[0]) - at)):
            n = int(np.searchsorted(-lengths, -(at + j), side="left"))
            state[:n] = step(state[:n], columns[j, :n])
    out = np.empty_like(state)
    out[order] = state
    return out


def fnv_lanes(contents: list[bytes]) -> list[str]:
    """Two FNV-1a lanes with different seeds, as little-endian hex, 16 bytes together."""
    n, prime = len(contents), np.uint64(FNV_PRIME)
    with np.errstate(over="ignore"):
        step = lambda h, b: (h ^ b.astype(np.uint64)) * prime
        lanes = [fold_bytes(contents, np.full(n, seed, np.uint64), step) for seed in (FNV_SEED_A, FNV_SEED_B)]
    return [a.tobytes().hex() + b.tobytes().hex() for a, b in zip(*lanes, strict=True)]


@F.pandas_udf(StringType())
def fnv_checksum(content: pd.Series) -> pd.Series:
    known = content.notna()
    out = pd.Series([None] * len(content), index=content.index, dtype=object)
    out[known] = fnv_lanes([bytes(x) for x in content[known]])
    return out


@F.pandas_udf(LongType())
def rolling_hash(content: pd.Series) -> pd.Series:
    """The chunker's 32-bit rolling value over a whole content, from 0."""
    known = content.notna()
    step = lambda h, b: (h * np.uint32(33)) ^ b.astype(np.uint32)
    items = [bytes(x) for x in content[known]]
    out = pd.Series([None] * len(content), index=content.index, dtype="Int64")
    with np.errstate(over="ignore"):
        out[known] = fold_bytes(items, np.zeros(len(items), np.uint32), step).astype(np.int64)
    return out


@F.pandas_udf(StringType())
def blake2_128(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else hashlib.blake2b(bytes(x), digest_size=16).hexdigest())


def block_key(*parts: Column) -> Column:
    """A dedup key over all that must be equal for two blocks to be one."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def megabytes(n: Column) -> Column:
    """Bytes in units of 10^6, null-safe."""
    return n / 1_000_000.0


def zpaq_level(stamp: Column, default: int = 4) -> Column:
    """The method number of a codec stamp like "zpaq-m5"."""
    digits = F.regexp_extract(stamp, r"^zpaq-m([0-9]+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(default))
