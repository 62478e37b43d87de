"""Ranks and running totals over a whole table without a task that sees every row.

The table is sorted by range once and written; each part's rows and sums make a table of one row per
part, whose own running totals are the parts' offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratapack.session import materialize


def running_totals(spark: SparkSession, df: DataFrame, order: list[Column], value: Column | None = None) -> DataFrame:
    """df with position (from 0 in the given order) and, if asked, before: the sum of value over earlier rows."""
    value = F.lit(0) if value is None else value
    sorted_rows = df.withColumn("_value", value.cast("long")).orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    table = materialize(spark, sorted_rows, "sorted").withColumn("_part", F.shiftright("_at", 33))
    parts = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = table.withColumn("_inner", F.coalesce(F.sum("_value").over(inner), F.lit(0))).join(F.broadcast(parts), "_part")
    position = F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*df.columns, position.cast("long").alias("position"), (F.col("_offset") + F.col("_inner")).cast("long").alias("before"))
