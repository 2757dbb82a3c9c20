"""Word grids, emissions, cells and batches on hand-written rows."""

import pytest

from spanframe.operators import ensembling as E


def test_grouped_words(spark):
    tokens = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0, 0), (0, 3), (3, 5), (5, 6), (7, 9), (9, 9)])], "doc_id long, token long, start long, end long")
    got = E.grouped_words(tokens, spark.createDataFrame([(1, "Toshk, ab")], "doc_id long, text string")).collect()
    assert {r["token"]: r["word"] for r in got} == {1: 0, 2: 0, 3: 1, 4: 2}


def emissions(spark, tokens, words):
    t = spark.createDataFrame([(1, i, a, b, p) for i, (a, b, p) in enumerate(tokens)], "doc_id long, token long, start long, end long, probs array<double>")
    w = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(words)], "doc_id long, word long, start long, end long")
    return {r["word"]: r["probs"] for r in E.word_emissions(t, w, 3).collect()}


def test_word_emissions_keep_mass(spark):
    got = emissions(spark, [(0, 2, [0.2, 0.6, 0.2]), (2, 4, [0.4, 0.1, 0.5])], [(0, 4), (5, 6)])
    assert got[0] == pytest.approx([0.3, 0.7 * 0.75, 0.7 * 0.25]) and got[1] == [1, 0, 0]


def test_a_token_counts_for_every_word_it_meets(spark):
    got = emissions(spark, [(0, 5, [0.1, 0.7, 0.2])], [(0, 2), (3, 5), (6, 8)])
    assert got[0] == pytest.approx([0.1, 0.7, 0.2]) and got[1] == pytest.approx([0.1, 0.0, 0.9]) and got[2] == [1, 0, 0]


def test_cells_on_words_and_their_mean(spark):
    grid = "doc_id long, word long, start long, end long"
    cells = spark.createDataFrame([(1, 0, 0, [0.5, 0.5]), (1, 0, 1, [0.1, 0.9])], "doc_id long, first long, last long, probs array<double>")
    own = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 6)], grid)
    words = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 3, 6)], grid)
    got = {(r["first"], r["last"]): r["probs"] for r in E.cells_on_words(cells, own, words, 3).collect()}
    assert got == {(0, 1): [0.5, 0.5], (0, 2): [0.1, 0.9]}
    assert E.cells_on_words(cells, own, words, 2).count() == 1
    other = spark.createDataFrame([(1, 0, 2, [0.3, 0.7])], cells.schema)
    both = E.combined([(E.cells_on_words(cells, own, words, 3), 1.0), (other, 3.0)], ["doc_id", "first", "last"], 2)
    got = {(r["first"], r["last"]): r["probs"] for r in both.collect()}
    assert got[0, 2] == pytest.approx([0.25, 0.75]) and got[0, 1] == pytest.approx([0.875, 0.125])


def test_label_sets():
    assert E.check_label_sets({"a": ["X", "Y"], "b": ["Y", "X"]}) == ("X", "Y")
    with pytest.raises(ValueError, match="lack"):
        E.check_label_sets({"a": ["X", "Y"], "b": ["Y"]})


def test_length_batches():
    assert E.length_batches([3, 9, 1, 20, 3], 3, 12) == [[3], [1], [0, 4, 2]]


def test_emissions_of_many_documents_at_once(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    monkeypatch.setattr(E, "PAIRS", 50)
    for nested in (False, True):
        tokens, words = [], []
        for d in range(12):
            cuts = np.sort(rnd.choice(60, 20, replace=False))
            t = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            t += [(5, 50), (5, 5), (7, 9), (7, 30)] * nested
            tokens += [(d, i, a, b, [float(x) for x in rnd.dirichlet(np.ones(5))]) for i, (a, b) in enumerate(sorted(t)) if d != 4]
            words += [(d, i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(np.sort(rnd.integers(0, 70, 15)), rnd.integers(0, 9, 15), strict=True))]
        t = spark.createDataFrame(tokens, "doc_id long, token int, start long, end long, probs array<double>")
        w = spark.createDataFrame(words, "doc_id long, word int, start long, end long")
        want = {(r["doc_id"], r["word"]): r["probs"] for r in E.word_emissions(t, w, 5).collect()}
        col = lambda rows, k: np.array([r[k] for r in rows])
        got = E.emissions(tuple(col(words, k) for k in (0, 2, 3)), tuple(col(tokens, k) for k in (0, 2, 3)), col(tokens, 4))
        assert np.allclose(got, [want[d, i] for d, i, _, _ in words], atol=1e-12)


def test_query_of_emissions_deals_nothing(spark):
    from spanframe.plans.decode_queries import word_emissions

    plan = word_emissions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
