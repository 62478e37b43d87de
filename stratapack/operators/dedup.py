"""Exact deduplication of files and blocks: the first copy in order is canonical.

Keys are reduced to their smallest id with map-side partial aggregation and joined back, so a group of
copies of any size never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_copy(rows: DataFrame, key: Column, order: Column, name: str = "first") -> DataFrame:
    """rows with the smallest `order` value among the rows of equal key. A null key is its own group."""
    keyed = rows.withColumn("_key", key)
    firsts = keyed.groupBy("_key").agg(F.min(order).alias(name)).withColumnRenamed("_key", "_k")
    return keyed.join(firsts, F.col("_key").eqNullSafe(F.col("_k"))).drop("_key", "_k")


def fixed_blocks(files: DataFrame, block: int) -> DataFrame:
    """file_id, block_idx, data, size of fixed-size blocks; an empty file has one empty block."""
    n = F.greatest(F.ceil(F.octet_length("content") / block), F.lit(1)).cast("int")
    at = files.select("file_id", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block_idx"))
    data = F.substring("content", F.col("block_idx") * block + 1, F.lit(block))
    return at.select("file_id", "block_idx", data.alias("data")).withColumn("size", F.octet_length("data").cast("long"))


def resolve_copies(spans: DataFrame, canonical: DataFrame) -> DataFrame:
    """Each span gets its canonical block by block_key; one that has none makes the query fail."""
    found = spans.join(canonical, "block_key", "left")
    refuse = F.raise_error(F.concat(F.lit("unresolved span of file "), F.col("file_id").cast("string"))).cast("string")
    return found.withColumn("block_id", F.coalesce("block_id", refuse))
