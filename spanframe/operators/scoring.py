"""Exact-span scoring: tables of spans (doc_id, start, end, label) joined and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import LABELS
from spanframe.functions.text import ratio

KEY = ["doc_id", "start", "end", "label"]


def match(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Full outer join on the whole key: tp, fp, fn as 0 or 1. Duplicates of a key count once."""
    g, p = gold.select(*KEY).distinct().withColumn("g", F.lit(1)), pred.select(*KEY).distinct().withColumn("p", F.lit(1))
    j = g.join(p, KEY, "full_outer")
    one = lambda c: c.cast("int")
    return j.select(*KEY, one(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), one(F.col("g").isNull()).alias("fp"), one(F.col("p").isNull()).alias("fn"))


COUNTS = ("tp", "fp", "fn")


def summed():
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]


def with_prf(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn; 0 where a denominator is."""
    tp, fp, fn = (F.col(c) for c in COUNTS)
    return df.withColumns({"precision": F.round(ratio(tp, tp + fp), 6), "recall": F.round(ratio(tp, tp + fn), 6), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), 6)})


def label_metrics(matched: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """scope, counts and ratios per label, micro (pooled) and macro (mean over the fixed labels, counts null)."""
    spark = matched.sparkSession
    dim = spark.createDataFrame([(x,) for x in labels], "label string")
    per = matched.groupBy("label").agg(*summed())
    full = F.broadcast(dim).join(per, "label", "left").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))
    own = with_prf(full.withColumnRenamed("label", "scope"))
    micro = with_prf(full.agg(*summed()).select(F.lit("micro").alias("scope"), *COUNTS))
    raw = full.select(*COUNTS)
    tp, fp, fn = (F.col(c) for c in COUNTS)
    macro = raw.agg(*(F.round(F.avg(x), 6).alias(n) for n, x in (("precision", ratio(tp, tp + fp)), ("recall", ratio(tp, tp + fn)), ("f1", ratio(2 * tp, 2 * tp + fp + fn)))))
    macro = macro.select(F.lit("macro").alias("scope"), *(F.lit(None).cast("long").alias(c) for c in COUNTS), "precision", "recall", "f1")
    return own.unionByName(micro).unionByName(macro)


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of spans of one document that overlap (half-open), as columns a_* and b_*; the id is the equi key."""
    x = a.select("doc_id", *(F.col(c).alias(f"a_{c}") for c in KEY[1:]))
    y = b.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in KEY[1:]))
    return x.join(y, "doc_id").where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))


def error_kinds(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """kind and n: type_only, boundary_only, spurious for false positives; missed for untouched false negatives."""
    m = match(gold, pred)
    fp, fn = m.where("fp = 1").select(*KEY), m.where("fn = 1").select(*KEY)
    same = gold.select("doc_id", "start", "end", F.lit(True).alias("same")).distinct()
    near = overlaps(fp, gold).select("doc_id", *(F.col(f"a_{c}").alias(c) for c in KEY[1:]), F.lit(True).alias("near")).distinct()
    kinds = fp.join(same, ["doc_id", "start", "end"], "left").join(near, KEY, "left").select(F.when(F.col("same"), "type_only").when(F.col("near"), "boundary_only").otherwise("spurious").alias("kind"))
    touched = overlaps(fn, pred).select("doc_id", *(F.col(f"a_{c}").alias(c) for c in KEY[1:])).distinct()
    missed = fn.join(touched, KEY, "left_anti").select(F.lit("missed").alias("kind"))
    return kinds.unionAll(missed).groupBy("kind").agg(F.count("*").alias("n"))


def sliced_metrics(matched: DataFrame, slices: DataFrame, column: str) -> DataFrame:
    """Counts by label, by the slice that slices (doc_id, column) names, and over all, in one pass."""
    j = matched.join(slices, "doc_id")
    sets = j.groupingSets([["label"], [column], []], "label", column).agg(*summed(), F.grouping("label").alias("gl"), F.grouping(column).alias("gs"))
    scope = F.when(F.col("gl") == 0, F.concat(F.lit("label:"), "label")).when(F.col("gs") == 0, F.concat(F.lit("slice:"), column)).otherwise("all")
    return with_prf(sets.select(scope.alias("scope"), *COUNTS))


def document_accuracy(matched: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents, those whose two key sets are equal, and their share; documents without spans are equal."""
    wrong = matched.groupBy("doc_id").agg(F.max(F.greatest("fp", "fn")).alias("wrong"))
    j = docs.select("doc_id").join(wrong, "doc_id", "left")
    right = F.count_if(F.coalesce("wrong", F.lit(0)) == 0)
    return j.agg(F.count("*").alias("n_docs"), right.alias("n_right"), F.round(ratio(right, F.count("*")), 6).alias("accuracy"))
