"""What the two searches over vectors share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INFINITY = float("inf")


def finite(vector: Column) -> Column:
    """Not null or empty, no null, NaN or infinite component."""
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < INFINITY)), F.lit(False))


def clean(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """vec_id, vector (doubles) of the rows that take part: of the most common length (of equals the shorter)."""
    v = F.col(vector_col)
    ok = finite(v) & F.col(id_col).isNotNull()
    if nonzero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return rows.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def common_length(vectors: DataFrame) -> tuple[int, int]:
    """The most common length and how many vectors have it."""
    row = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (row["d"], row["count"]) if row else (0, 0)


def matrix(column: pd.Series, d: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, d))


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Where the k smallest scores stand, nearest first, ties to the smaller id; all of them if fewer."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return near[np.lexsort((ids[near], scores[near]))[:k]]
    return np.lexsort((ids, scores))[:k]


def top(partial: DataFrame, k: int, order: Column) -> DataFrame:
    """Merge every task's best into each query's k best: Spark limits each task's share before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
