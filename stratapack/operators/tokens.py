"""Token statistics for the dictionary transform, relationally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_dictionary(rows: DataFrame, id_col: str, text: Column, top: int = 16) -> DataFrame:
    """Per row the `top` tokens by (saving, length, token): id, token, n, saving, rank."""
    tokens = rows.select(id_col, F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]{4,}"), F.lit(0))).alias("token"))
    stats = tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    saving = F.col("n") * (F.length("token") - 2)
    stats = stats.withColumn("saving", saving.cast("long")).where((F.col("n") > 1) & (F.col("saving") > F.length("token")))
    order = Window.partitionBy(id_col).orderBy(F.desc("saving"), F.desc(F.length("token")), "token")
    return stats.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
