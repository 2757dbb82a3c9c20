"""Ensembles of whole documents: as the tables of cells, without a shuffle, many documents at a time."""

import random

from pyspark.sql import functions as F

from spanframe.operators import decoding as D
from spanframe.operators import ensembling as E
from spanframe.operators import fixtures as X

TYPES, WIDTH, WEIGHTS = ("GEO", "ORG"), 3, (2.0, 1.0)
KIND = "doc_id long, text string, start array<int>, end array<int>, tags array<array<double>>, cells array<struct<first:int,last:int,probs:array<double>>>"


def _documents(spark):
    rng = random.Random(5)

    def shares(n):
        raw = [rng.randrange(1, 50) for _ in range(n)]
        return [x / sum(raw) for x in raw]

    rows = [(90, None, None, None, None, None), (91, "", [], [], [], []), (92, "ab", [0], [2], [shares(5)], None)]
    for d in range(30):
        n = rng.choice([1, 2, 3, 40])
        cells = [(i, i + rng.randrange(WIDTH), shares(3)) for i in rng.sample(range(n), (n + 1) // 2)]
        rows.append((d, "​ab " * n, [4 * i for i in range(n)], [4 * i + 3 for i in range(n)], [shares(5) for _ in range(n)], cells + cells[:1]))
    return spark.createDataFrame(rows, KIND)


def _cells(docs):
    tags = docs.select("doc_id", F.posexplode("tags").alias("word", "probs")).withColumn("word", F.col("word").cast("long"))
    spans = docs.select("doc_id", F.inline("cells")).select("doc_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "probs")
    both = E.combined([(spans, WEIGHTS[0]), (D.tag_cells(tags, WIDTH, 5), WEIGHTS[1])], ["doc_id", "first", "last"], 3)
    return both.withColumn("probs", F.transform("probs", lambda p: F.round(p, E.DIGITS)))


def test_as_the_tables_of_cells(spark):
    docs = _documents(spark)
    cells = _cells(docs).cache()
    words = docs.select("doc_id", F.posexplode(F.arrays_zip("start", "end")).alias("word", "w")).select("doc_id", "word", "w.start", "w.end")
    for mode in ("greedy", "dp"):
        got = E.decode_documents(docs, TYPES, WIDTH, WEIGHTS, mode, 0.8, {"ORG": 1.2})
        want = D.decode_cells(cells, words, docs, TYPES, WIDTH, mode, 0.8, {"ORG": 1.2})
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    want = {r["doc_id"]: (r["n"], [r["a"], r["b"], r["c"]]) for r in cells.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum(F.get("probs", F.lit(i))).alias(c) for i, c in enumerate("abc"))).collect()}
    got = {r["doc_id"]: (r["n"], r["mass"]) for r in E.document_masses(docs, WIDTH, 5, WEIGHTS).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == n and max(abs(x - y) for x, y in zip(got[d][1], m, strict=True)) < 1e-9 for d, (n, m) in want.items())


def test_documents_stay_where_they_are(spark):
    from spanframe.plans.registry import queries

    for name in ("ensemble_cells", "ensemble_spans", "ensemble_best_spans"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Generate"))


def test_placed_words_as_the_word_table(spark):
    docs = spark.createDataFrame(list(enumerate(["", None, "Anna  \U0001f600 Ülo\nB ", "a Berta Émile x"])), "doc_id long, text string")
    rows = X.placed_words(docs)
    got = rows.select("doc_id", F.posexplode(F.arrays_zip("start", "end")).alias("pos", "w")).select("doc_id", "pos", "w.start", "w.end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, X.word_table(docs).select("doc_id", "pos", "start", "end").collect()))
    assert {r["doc_id"]: r["named"] for r in rows.collect()} == {0: [], 2: [0], 3: [1, 2]}
