"""A training corpus from `documents` in four stages, each one operator of spanframe.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps, with
the columns of documents, but for the last, which returns the packed pieces. Nulls, empty texts, ties,
repeated rows and an empty table pass through each stage as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanframe.llm.common import bounded, crc_mod, divided, stored
from spanframe.llm.jaccard import similar_components
from spanframe.llm.langid import fit, identify, training_sample
from spanframe.llm.packing import pack
from spanframe.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected when it is `und`, or no language has so large a share of its words.
LANGUAGE_SHARE = 0.4
#: Near duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILAR, OF = 5, 80, 100
TOKENIZER, SEQUENCE = "byte_bpe_50k.json", 2048


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bounded(spark)
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; learns from those whose crc32(doc_id) mod 3 is not 1.

    Null texts and texts without a letter go (`und`). Without a labelled document to learn from, all go.
    """
    docs = _ready(spark, docs)
    crf = fit(training_sample(docs.where(crc_mod("doc_id", 3) != 1)))
    kept = identify(docs, crf, keep=list(COLUMNS[1:]))
    return kept.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by similarity: that with the smallest doc_id.

    Of rows that share id and text one stays; texts without words link with nothing and stay.
    """
    docs = _ready(spark, docs)
    groups = stored(similar_components(docs, SHINGLE_WORDS, SIMILAR, OF), "groups")
    first = groups.where("is_first").select(F.col("doc_id").alias("kept_id"))
    # Only texts whose id may be that of a document that goes are shuffled.
    sure, rest = divided(docs, "doc_id", groups.where(~F.col("is_first")).select("doc_id"))
    kept = sure.unionAll(rest.join(first.distinct(), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi"))
    if groups.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; n_chars is that of the new text.

    Only documents of which nothing but white space is left by the cuts go.
    """
    out = remove_repeats(_ready(spark, docs))
    gone = (F.size("spans") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\s]"), F.lit(False))
    return out.where(~gone).withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents left into sequences of at most SEQUENCE tokens."""
    return pack(_ready(spark, docs), TOKENIZER, SEQUENCE)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the filters around them can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole documents table, each one's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
