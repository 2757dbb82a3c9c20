"""Validation rules for entities, records, requests and settings, as Boolean columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import LABELS
from spanframe.functions.text import let


def sorted_entities(entities: Column) -> Column:
    """By start, end, label."""
    swapped = F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    return F.transform(F.array_sort(swapped), lambda e: F.struct(e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end")))


def entity_errors(entities: Column, text_length: Column, labels: tuple[str, ...] | None = LABELS) -> dict[str, Column]:
    """bad_label (domain, or any non-empty string without one), bad_bounds, duplicate and overlap (half-open)."""
    known = (lambda e: e["label"].isin(*labels)) if labels else (lambda e: F.coalesce(e["label"], F.lit("")) != "")
    in_text = lambda e: F.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= text_length), F.lit(False))
    cross = lambda own, i: F.coalesce(F.get(own, i)["start"] < F.get(own, i - 1)["end"], F.lit(False))
    pairs = let(sorted_entities(entities), lambda own: F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda i: cross(own, i)))
    return {
        "bad_label": ~F.forall(entities, lambda e: F.coalesce(known(e), F.lit(False))),
        "bad_bounds": ~F.forall(entities, in_text),
        "duplicate": F.size(F.array_distinct(entities)) < F.size(entities),
        "overlap": F.exists(pairs, lambda b: b),
    }


def valid(entities: Column, text_length: Column, labels: tuple[str, ...] | None = LABELS, overlap_allowed: bool = False) -> Column:
    """The scorer allows overlap; records and the baseline do not. Null lists are invalid."""
    e = entity_errors(entities, text_length, labels)
    bad = e["bad_label"] | e["bad_bounds"] | e["duplicate"] | (F.lit(False) if overlap_allowed else e["overlap"])
    return F.coalesce(~bad, F.lit(False))


def check_pair(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """hash and error of predictions that do not fit the gold records: missing, extra, other text, invalid spans."""
    g = gold.select("hash", F.col("text").alias("g_text"), F.lit(True).alias("g"))
    p = pred.select("hash", F.col("text").alias("p_text"), "entities", F.lit(True).alias("p"))
    j = g.join(p, "hash", "full_outer")
    error = (
        F.when(F.col("p").isNull(), "missing").when(F.col("g").isNull(), "extra").when(F.col("p_text").isNotNull() & (F.col("p_text") != F.col("g_text")), "text").when(~valid(F.col("entities"), F.length("g_text"), overlap_allowed=True), "spans")
    )
    return j.select("hash", error.alias("error")).where("error is not null")


def request_errors(items: DataFrame) -> DataFrame:
    """The first faulty item of each request: columns request, position, hash, text in; request, position, error out."""
    seen = items.groupBy("request", "hash").agg(F.min("position").alias("first"))
    j = items.join(seen, ["request", "hash"], "left")
    error = F.when(F.coalesce("hash", F.lit("")) == "", "hash").when(F.col("text").isNull(), "text").when(F.col("position") > F.col("first"), "repeated")
    return j.withColumn("error", error).where("error is not null").groupBy("request").agg(F.min(F.struct("position", "error")).alias("m")).select("request", "m.position", "m.error")


def source_agreement(df: DataFrame, column: str, weights: Mapping[str, float]) -> DataFrame:
    """Sources of the data or the settings that the other side lacks: source, side."""
    given = df.sparkSession.createDataFrame([(k,) for k in weights] or [("",)], f"{column} string").limit(len(weights))
    seen = df.select(column).distinct()
    a = seen.join(given, column, "left_anti").select(column, F.lit("no weight").alias("side"))
    return a.unionAll(given.join(seen, column, "left_anti").select(column, F.lit("no data").alias("side")))


def unknown_labels(train: DataFrame, val: DataFrame, column: str = "label") -> DataFrame:
    """Labels of val that train lacks."""
    return val.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")


def check_tags(given: Iterable[str], types: Iterable[str]) -> None:
    """A model's tags are O and both tags of every type, no others."""
    expected = {"O", *(f"{p}-{t}" for t in types for p in "BI")}
    given = set(given)
    if given != expected:
        raise ValueError(f"missing tags {sorted(expected - given)}, unknown tags {sorted(given - expected)}")


def check_probabilities(values: Mapping[str, float], total: float | None = None, tolerance: float = 1e-6) -> None:
    """Settings: probabilities at most 1 together, or weights that sum to total."""
    s = sum(values.values())
    if any(v < 0 for v in values.values()) or (s > 1 + tolerance if total is None else abs(s - total) > tolerance):
        raise ValueError(f"{dict(values)} sum to {s}")


def check_window(length: int, stride: int) -> None:
    if not 0 <= stride < length:
        raise ValueError(f"stride {stride} of a window of {length}")
