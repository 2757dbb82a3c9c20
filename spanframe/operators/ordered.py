"""Running totals, caps, splits and interleaving over large ordered tables without a single-task window.

Rows carry an order column; `bucket` is a coarser column that never decreases along that order. A total
is the window's inside a bucket plus the sum of the buckets before it, of which there are few rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_before(df: DataFrame, value: Column, order: list[str], bucket: Column, by: list[str] | None = None, name: str = "before") -> DataFrame:
    """df and the sum of value over all rows before, within the groups of `by`; null is a group like others."""
    by = by or []
    rows = df.withColumns({"_v": value.cast("long"), "_b": bucket})
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_b").agg(F.sum("_v").alias("_t"))
    outer = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_b"]
    offsets = sums.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("_t").over(outer), F.lit(0)).alias("_o"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    j = rows.join(offsets, reduce(and_, same))
    return j.withColumn(name, (F.coalesce(F.sum("_v").over(inner), F.lit(0)) + F.col("_o")).cast("long")).drop("_v", "_b", "_o", *(f"_k{i}" for i in range(len(keys))))


def capped(df: DataFrame, value: Column, cap: Column, order: list[str], bucket: Column, by: list[str] | None = None) -> DataFrame:
    """Rows while the total before them is under the cap; the row that crosses it stays."""
    return running_before(df, value, order, bucket, by).where(F.col("before") < cap)


def row_index(df: DataFrame, order: list[str], bucket: Column, by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """0-based position in the order, within the groups of `by`."""
    return running_before(df, F.lit(1), order, bucket, by, name)


def islands(df: DataFrame, key: str, order: str, by: str) -> DataFrame:
    """island: number of the run of equal consecutive keys, from 1, within each group of `by`."""
    w = Window.partitionBy(by).orderBy(order)
    new = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from seed and keys alone: the first 13 hex digits of an md5."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16**13)
