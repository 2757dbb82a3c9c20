"""Words and spans of long texts and of many: what is dealt, what is found where texts are read, what stays off the driver."""

from pyspark.sql import functions as F

from spanframe.operators import fixtures as X


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_words_of_odd_texts(spark):
    texts = ["", None, "Anna  \U0001f600 Ülo\nB ", " Berta", "a Émile\n Word\n"]
    want = []
    for i, t in enumerate(texts):
        at = 0
        for pos, w in enumerate([] if t is None else t.split(" ")):
            want.append((i, pos, w, at, at + len(w)))
            at += len(w) + 1
    assert sorted(map(tuple, X.word_table(_docs(spark, *texts)).collect())) == want
    named = X.named_words(_docs(spark, *texts, "Anna Berta Émile Bob")).orderBy("doc_id", "pos").collect()
    assert [tuple(r) for r in named] == [(2, 0, "Anna", 0, 4, None), (3, 1, "Berta", 1, 6, ""), (5, 0, "Anna", 0, 4, None), (5, 1, "Berta", 5, 10, "Anna"), (5, 2, "Émile", 11, 16, "Berta")]


def test_texts_are_not_shuffled_for_their_spans(spark):
    plan = X.gold_spans(_docs(spark, "Anna Berta"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_parts_follow_the_texts(spark):
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 40_000).alias("text"))
    assert X.dealt(docs).rdd.getNumPartitions() == 6
    plan = X.word_table(docs).groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
