"""Connected components of an edge table by alternating large and small stars, one shuffle for each star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from spanframe.llm.common import dropped, stored

#: Rounds of both stars between two writes.
ROUNDS = 3


def _sorted(edges: DataFrame) -> DataFrame:
    """Each distinct edge once, with the least v of its u as m and whether it is the edge to that."""
    at = Window.partitionBy("u").orderBy("v")
    placed = edges.select("u", "v", F.first("v").over(at).alias("m"), F.lag("v").over(at).alias("before"))
    return placed.where("before is null or before <> v").select("u", "v", "m", F.col("before").isNull().alias("leads"))


def _large(edges: DataFrame, told: Observation | None = None) -> DataFrame:
    """told: how many edges keep the given ones from being stars around the least nodes."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = _sorted(edges.select(F.inline(ways)))
    if told is not None:
        # A node that has a lesser neighbour and any other is neither the middle nor an end of a star.
        both = both.observe(told, F.count(F.when((F.col("m") < F.col("u")) & ~F.col("leads"), 1)).alias("open"))
    return both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges lead from the greater to the lesser node, as _large() leaves them."""
    return _sorted(edges).select(F.when(F.col("leads"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of any ordered type -> (u, v): every node with edges but the least of its component, and that.

    Some rounds together are written to the shared folder; the rounds needed grow as the logarithm of the longest path.
    """
    now, kept = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        told = Observation()
        for i in range(ROUNDS):
            now = _small(_large(now, told if i == ROUNDS - 1 else None))
        now = stored(now, "edges")
        if kept is not None:
            dropped(kept)
        kept = now
        # Nothing is told of plans that Spark finds empty.
        if now.isEmpty() or not told.get["open"]:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of any ordered type -> (node, component): component is the least node reachable; only nodes with edges."""
    now = stars(edges)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
