"""Cell targets, smoothing and losses against dense numpy versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanframe.operators import span_targets as T

TYPES, WIDTH = ("ORG", "GEO", "NAME"), 4


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(3)
    words, spans = [], []
    for d in range(25):
        n = rnd.randint(1, 12)
        words += [(d, i, 3 * i, 3 * i + 2) for i in range(n)]
        for _ in range(rnd.randint(0, 5)):
            start = rnd.randint(0, 3 * n)
            spans.append((d, start, start + rnd.randint(1, 16), rnd.choice([*TYPES, "OTHER"])))
    spans = sorted(set(spans))
    return words, spans, spark.createDataFrame(words, "doc_id long, pos long, t_start long, t_end long"), spark.createDataFrame(spans, "doc_id long, start long, end long, label string")


def dense(words, spans):
    """(d) -> matrix of classes."""
    out = {}
    for d in {w[0] for w in words}:
        own = [w for w in words if w[0] == d]
        n = len(own)
        m = np.array([[0 if i + k < n else T.IGNORE for k in range(WIDTH)] for i in range(n)])
        for _, start, end, label in sorted(s for s in spans if s[0] == d and s[3] in TYPES):
            met = [i for _, i, a, b in own if a < end and start < b]
            if met and met[-1] - met[0] < WIDTH:
                m[met[0], met[-1] - met[0]] = 1 + sorted(TYPES).index(label)
        out[d] = m
    return out


def smooth(m, epsilon, distance):
    n = len(m)
    out = np.zeros((*m.shape, len(TYPES) + 1))
    for i, k in np.argwhere(m > 0):
        near = [(a, b) for a in range(n) for b in range(a, min(n, a + WIDTH)) if 0 < abs(a - i) + abs(b - i - k) <= distance]
        for a, b in near:
            out[a, b - a, m[i, k]] += epsilon / len(near)
        out[i, k, m[i, k]] += 1 - epsilon if near else 1
    out[..., 0] = np.maximum(0, 1 - out[..., 1:].sum(-1))
    return out / out.sum(-1, keepdims=True)


def test_targets_smoothing_and_loss(spark, made):
    words, spans, w, s = made
    want = dense(words, spans)
    cells = T.gold_cells(w, s, TYPES, WIDTH)
    got = {(r["doc_id"], r["word"]): r["targets"] for r in T.cell_targets(w, cells, WIDTH).collect()}
    assert got == {(d, i): row.tolist() for d, m in want.items() for i, row in enumerate(m)}

    lengths = w.groupBy("doc_id").agg(F.count("*").alias("n"))
    scores = {(d, i, k): [((d * 5 + i * 3 + k * 7 + c * 4) % 11) / 3 for c in range(4)] for d, m in want.items() for i in range(len(m)) for k in range(WIDTH)}
    x = spark.createDataFrame([(*k, v) for k, v in scores.items()], "doc_id long, word long, k long, scores array<double>")
    for epsilon, distance in ((0.2, 1), (0.3, 2)):
        targets = T.smoothed_targets(cells, lengths, TYPES, WIDTH, epsilon, distance)
        sparse = {(r["doc_id"], r["word"], r["k"]): r["target"] for r in targets.collect()}
        full = {d: smooth(m, epsilon, distance) for d, m in want.items()}
        for d, m in want.items():
            for i in range(len(m)):
                for k in range(WIDTH):
                    if i + k < len(m):
                        assert sparse.pop((d, i, k), [1, 0, 0, 0]) == pytest.approx(full[d][i, k].tolist())
        assert not sparse
        for r in T.span_losses(x, targets, lengths).collect():
            m = want[r["doc_id"]]
            inside = [(i, k) for i in range(len(m)) for k in range(WIDTH) if i + k < len(m)]
            loss = 0.0
            for i, k in inside:
                v = np.array(scores[r["doc_id"], i, k])
                loss -= float(full[r["doc_id"]][i, k] @ (v - math.log(np.exp(v).sum())))
            assert (r["loss"], r["n"]) == (pytest.approx(loss), len(inside))


def test_losses_of_many_documents_at_once(spark, made):
    words, spans, w, s = made
    ids = sorted({d for d, *_ in words})
    doc, place, start, end = np.array(words).T
    of = np.searchsorted(ids, doc)
    gold = np.array([(ids.index(d), a, b, 1 + sorted(TYPES).index(t)) for d, a, b, t in spans if t in TYPES]).T
    x = ((np.array(ids)[of] * 5 + place * 3)[:, None, None] + np.arange(WIDTH)[:, None] * 7 + np.arange(4) * 4) % 11 / 3
    lengths = w.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame([(int(doc[i]), int(place[i]), k, x[i, k].tolist()) for i in range(len(of)) for k in range(WIDTH)], "doc_id long, word long, k long, scores array<double>")
    for epsilon, distance in ((0.2, 1), (0.3, 2)):
        loss, n = T.grid_losses(of, x, *T.smoothed_grid((of, start, end), tuple(gold), len(TYPES), WIDTH, epsilon, distance), len(ids))
        want = {r["doc_id"]: (r["loss"], r["n"]) for r in T.span_losses(rows, T.smoothed_targets(T.gold_cells(w, s, TYPES, WIDTH), lengths, TYPES, WIDTH, epsilon, distance), lengths).collect()}
        assert {d: (pytest.approx(loss[i]), n[i]) for i, d in enumerate(ids) if n[i]} == want


def test_query_of_losses_deals_nothing(spark):
    from spanframe.plans.target_queries import span_loss

    assert "Exchange" not in span_loss(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_token_losses_and_reductions(spark):
    rows = [([0.0, 1.0, -2.0], 1), ([3.0, 0.5, 0.0], 2), ([1.0, 1.0, 1.0], T.IGNORE), ([700.0, -700.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "scores array<double>, target int")
    weights = (1.0, 2.0, 0.5)
    losses = []
    for scores, t in rows:
        if t != T.IGNORE:
            p = np.exp(np.array(scores) - max(scores))
            p /= p.sum()
            losses.append(((1 - p[t]) ** 2 * -math.log(p[t]), -math.log(p[t]), weights[t]))
    df = df.select(T.focal(F.col("scores"), F.col("target")).alias("f"), T.class_cross_entropy(F.col("scores"), F.col("target")).alias("c"), T.class_weight(weights, F.col("target")).alias("w"))
    got = df.agg(T.reduced(F.col("f"), "sum").alias("a"), T.reduced(F.col("c"), "mean").alias("b"), T.reduced(F.col("f"), "mean", F.col("w")).alias("c"), T.reduced(F.col("c"), "sum", F.col("w")).alias("d")).first()
    total = sum(w for _, _, w in losses)
    assert tuple(got) == pytest.approx((sum(f for f, _, _ in losses), sum(c for _, c, _ in losses) / 3, sum(f * w for f, _, w in losses) / total, sum(c * w for _, c, w in losses)))
    with pytest.raises(Exception, match="all targets are ignored"):
        df.where("c is null").agg(T.reduced(F.col("c"), "mean")).collect()
    with pytest.raises(ValueError, match="reduction"):
        T.reduced(F.col("c"), "other")


def test_nothing(spark, made):
    _, _, w, s = made
    none = T.gold_cells(w, s.limit(0), TYPES, WIDTH)
    lengths = w.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert none.count() == 0 and T.smoothed_targets(none, lengths, TYPES, WIDTH, 0.2).count() == 0 and T.cell_targets(w.limit(0), none, WIDTH).count() == 0
