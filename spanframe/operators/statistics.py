"""Statistics that need counts only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def index_percentiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row of sorted[min(n - 1, int(n p))] for each p: not interpolated, from the counts of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.orderBy(column))
    total = F.sum("_c").over(Window.partitionBy())
    rows = counts.select(column, upto.alias("_u"), total.alias("_n"))
    at = lambda p: F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))
    return rows.agg(*(F.min(F.when(F.col("_u") > at(p), F.col(column))).cast("long").alias(n) for n, p in wanted.items()))


def exact_mode(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The commonest value of each group, ties to the one seen first by `order`."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("c"), F.min(order).alias("first"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("c", -F.col("first"))).alias("mode"), F.sum("c").alias("n"))
