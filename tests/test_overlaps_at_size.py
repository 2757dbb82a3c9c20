"""Overlaps, tags and cells of long documents: as pair by pair, and without words being dealt or sorted again."""

import random

from pyspark.sql import functions as F

from spanframe.functions import translit as X
from spanframe.operators import alignment as A
from spanframe.operators import decoding as D
from spanframe.operators import ensembling as E
from spanframe.operators import fixtures as W


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _dealt(spark):
    return spark.createDataFrame([(0, "Anna und Berta")], "doc_id long, text string")


def test_overlaps_as_pair_by_pair(spark):
    rng = random.Random(3)
    tokens = [(d, p, s, s + rng.choice([0, 1, 5, 200])) for d in range(3) for p, s in enumerate(range(0, 9000, 90))]
    spans = [(rng.randrange(4), s, s + rng.choice([0, 1, 64, 300, 5000]), "ORG") for s in (rng.randrange(9000) for _ in range(40))]
    spans += spans[:3]
    want = sorted((d, p, s, e) for d, p, a, b in tokens for o, s, e, _ in spans if o == d and a < e and s < b)
    t, s = spark.createDataFrame(tokens, "doc_id long, pos int, t_start long, t_end long"), spark.createDataFrame(spans, "doc_id long, start long, end long, label string")
    assert sorted(map(tuple, A.overlapping(t, s).select("doc_id", "pos", "start", "end").collect())) == want


def test_tokens_stay_where_they_are(spark):
    docs = _dealt(spark)
    tokens = W.word_table(docs).select("doc_id", "pos", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    for out in (A.covering_tags(tokens, W.gold_spans(docs)), A.overlapping(tokens, W.gold_spans(docs))):
        plan = _plan(out)
        assert "ShuffledHashJoin" in plan and "hashpartitioning(doc_id" in plan and "pos#" not in "".join(x for x in plan.split("\n") if "Exchange" in x or "+- Sort" in x)


def test_runs_of_many_tags(spark):
    tags = ["B-ORG", "I-ORG", "I-GEO", "O", "E-GEO", "S-NAME", "X-ORG", "I-ORG", "I-", None] * 4000
    for orphans in (True, False):
        want, run = [], None
        for i, t in enumerate(tags):
            p, k = (t[:1], t[2:]) if t else ("", "")
            if run and p in ("I", "E") and run[2] == k:
                run[1] = i
                continue
            if run:
                want.append(tuple(run))
            run = [i, i, k] if p and (p in "BS" or (orphans and p in "IE")) else None
        want += [tuple(run)] if run else []
        df = spark.createDataFrame([(tags,), ([],), (None,)], "tags array<string>")
        got = [r[0] for r in df.select(A.decode_tags(F.col("tags"), orphans)).collect()]
        assert [list(map(tuple, x)) if x is not None else None for x in got] == [want, [], None]


def test_words_of_tokens_far_into_a_text(spark):
    text = "\U0001f600 " * 300 + "abc" + "-" + "de"
    tokens = [(0, 0, 600, 602), (0, 1, 602, 603), (0, 2, 603, 604), (0, 3, 604, 606)]
    out = E.grouped_words(spark.createDataFrame(tokens, "doc_id long, token long, start long, end long"), spark.createDataFrame([(0, text)], "doc_id long, text string"))
    assert [r["word"] for r in out.orderBy("token").collect()] == [0, 0, 1, 2]
    assert "text#" not in "".join(x for x in _plan(out).split("\n") if "Join" in x or "Sort" in x or "Window" in x)


def test_latin_words_as_letter_by_letter(spark):
    texts = ["ели ееЕ ель Ёлка ЁЛКА ёж ЩИ Щи щи объезд ъе ье 1е е1 ўғқҳ abc Я я Ье", "", "Ее-еЕ ЕЕ İе"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(X.cyrillic_to_latin(F.col("t")).alias("a"), F.array_join(F.transform(X.latin_pieces(F.col("t")), lambda p: p["piece"]), "").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_cells_of_both_models_meet_without_a_shuffle(spark):
    grid = W.word_table(_dealt(spark))
    tags = grid.select("doc_id", F.col("pos").cast("long").alias("word"), F.array(*(F.lit(0.2) for _ in range(5))).alias("probs"))
    spans = grid.where("pos = 0").select("doc_id", F.col("pos").cast("long").alias("first"), F.col("pos").cast("long").alias("last"), F.array(*(F.lit(0.3) for _ in range(3))).alias("probs"))
    both = E.combined([(spans, 2.0), (D.tag_cells(tags, 3, 5), 1.0)], ["doc_id", "first", "last"], 3)
    assert not any("Exchange" in x and "first#" in x for x in _plan(both).split("\n"))


def test_log_softmax_takes_its_sums_once(spark):
    from spanframe.operators.span_targets import log_softmax

    df = spark.createDataFrame([([0.5, 1.5, -2.0, 0.0],)], "x array<double>").select(log_softmax(F.col("x")).alias("y"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_max(") == 1
    assert abs(sum(2.718281828459045**v for v in df.first()[0]) - 1) < 1e-9
