"""Reports: what sources gave, how often they are drawn, where predictions fail, metrics as lines."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.operators.sampling import quotas
from spanframe.operators.scoring import KEY


def source_report(docs: DataFrame, mentions: DataFrame, order: Column | None = None) -> DataFrame:
    """source, label, n_docs, n_mentions, n_added: n_added stems of the label are in no source before it.

    docs: source; mentions: source, label, stem, script. Sources come by `order` (of source), by name where none is
    given. A stem is the same in any case. The first two counts are of the source, over all labels.
    """
    turn = F.col("source") if order is None else order
    first = mentions.groupBy("label", F.lower("stem").alias("key"), "script").agg(F.min_by("source", turn).alias("source"))
    added = first.groupBy("source", "label").agg(F.count("*").alias("n_added"))
    n_docs = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    n_mentions = mentions.groupBy("source").agg(F.count("*").alias("n_mentions"))
    labels = mentions.select("source", "label").distinct()
    rows = labels.join(n_docs, "source", "left").join(n_mentions, "source").join(added, ["source", "label"], "left")
    return rows.select("source", "label", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "n_mentions", F.coalesce("n_added", F.lit(0)).alias("n_added"))


def coverage(df: DataFrame, source: str, weights: Mapping[str, float], size: int) -> DataFrame:
    """source, n, draws, weight, coverage: an epoch of `size` draws against the records that each source has."""
    want = [(k, quotas(weights, size)[k], float(w)) for k, w in weights.items()]
    need = df.sparkSession.createDataFrame(want, f"{source} string, draws long, weight double")
    n = df.groupBy(source).agg(F.count("*").alias("n"))
    j = F.broadcast(need).join(n, source, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select(source, "n", "draws", "weight", F.round(F.col("draws") / F.greatest("n", F.lit(1)), 2).alias("coverage"))


def error_sample(matched: DataFrame, docs: DataFrame, most: int = 20, width: int = 300) -> DataFrame:
    """doc_id, text, missed, spurious of the first documents by id whose spans differ; texts are cut at `width`.

    matched: doc_id, start, end, label, tp, fp, fn. missed and spurious list label:surface by start.
    """
    wrong = matched.where("fp + fn > 0")
    few = wrong.select("doc_id").distinct().orderBy("doc_id").limit(most)
    texts = docs.join(F.broadcast(few), "doc_id").select("doc_id", "text")
    spans = wrong.select(*KEY, "fp").join(F.broadcast(few), "doc_id").join(texts, "doc_id")
    shown = F.concat_ws(":", "label", F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")))
    item = F.struct("start", "end", "label", shown.alias("shown"))

    def listed(kind: int) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("fp") == kind, item))), lambda x: x["shown"]), ", ")

    rows = spans.groupBy("doc_id").agg(listed(0).alias("missed"), listed(1).alias("spurious"))
    cut = F.when(F.length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("…"))).otherwise(F.col("text"))
    return texts.join(rows, "doc_id").select("doc_id", cut.alias("text"), "missed", "spurious")


def metrics_lines(metrics: DataFrame) -> DataFrame:
    """scope and line: each row of scope, precision, recall, f1, tp, fp, fn as text of fixed widths; a null count is a dash, halves go to the even digit."""
    numbers = [F.format_string("%10.4f", F.bround(c, 4)) for c in ("precision", "recall", "f1")]
    counts = [F.lpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), 8, " ") for c in ("tp", "fp", "fn")]
    return metrics.select("scope", F.concat_ws(" ", F.rpad("scope", 8, " "), *numbers, *counts).alias("line"))


def parse_scales(items: list[str]) -> dict[str, float]:
    """["ORG=1.2"] as {"ORG": 1.2}; an item without a name or a number is an error."""
    out = {}
    for item in items:
        name, _, value = item.partition("=")
        if not name.strip() or not value:
            raise ValueError(f"not NAME=FACTOR: {item!r}")
        out[name.strip()] = float(value)
    return out
