"""Replacements against the rules that they state."""

import random

from pyspark.sql import functions as F

from spanframe.operators import pool as P

POOL = "label string, stem string, n_words int, script string, lang string"
MENTION = "id long, label string, stem string, script string, lang string"


def test_every_mention_with_another_stem_is_replaced(spark):
    rnd = random.Random(1)
    pool = [("ORG", f"Stem{i}", 1 + i % 3, "latin", "uz") for i in range(10)] + [("ORG", "Lone", 1, "latin", "ru"), ("GEO", "Only", 1, "latin", "uz")]
    mentions = [(i, "ORG", f"Stem{rnd.randrange(12)}", "latin", "uz") for i in range(200)]
    mentions += [(500, "ORG", "Lone", "latin", "ru"), (501, "ORG", "lone", "latin", "ru"), (502, "GEO", "only", "latin", "uz"), (503, "GEO", "Other", "latin", None), (504, "ORG", "X", "cyrillic", "uz"), (505, "ORG", "Y", "latin", "fr")]
    mentions += mentions[:5]
    stock, asked = spark.createDataFrame(pool, POOL), spark.createDataFrame(mentions, MENTION)
    got = {(r["id"], r["label"], r["stem"]): r["new"] for r in P.replacements(asked, stock, 3).collect()}
    assert set(got) == {(i, n, s) for i, n, s, _, _ in mentions if i not in (502, 504)}
    assert all(new.lower() != stem.lower() for (_, _, stem), new in got.items())
    assert all(new.startswith("Stem") for (i, _, _), new in got.items() if i < 200)
    assert len({new for (i, _, _), new in got.items() if i < 200}) == 10
    # No other stem of its language: any language.
    assert got[500, "ORG", "Lone"].startswith("Stem") and got[503, "GEO", "Other"] == "Only" and got[505, "ORG", "Y"]


def test_replacement_limits_and_weights(spark):
    pool = [("ORG", "One", 1, "latin", "uz"), ("ORG", "Two two", 2, "latin", "uz"), ("ORG", "Three three three three", 4, "latin", "uz")]
    stock = spark.createDataFrame(pool, POOL)
    asked = spark.createDataFrame([(i // 3, "ORG", f"M{i}", "latin", "uz") for i in range(3_000)], MENTION)
    few = P.replacements(asked, stock, 3, extra=1, max_per_doc=2).groupBy("id").count().collect()
    assert len(few) == 1_000 and {r["count"] for r in few} == {2}
    assert {r["new"] for r in P.replacements(asked, stock, 3, extra=1).collect()} == {"One", "Two two"}
    share = {r["new"]: r["count"] / 3_000 for r in P.replacements(asked, stock, 3, bias=1.0).groupBy("new").count().collect()}
    assert all(abs(share[s] - n / 7) < 0.04 for _, s, n, _, _ in pool)
    assert P.replacements(asked.limit(0), stock, 3).count() == 0 and P.replacements(asked, stock.limit(0), 3).count() == 0


def _draws(spark, pool, mentions, **kw):
    rows = P.replacements(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(pool, POOL), 3, **kw).collect()
    return {(r["id"], r["label"], r["stem"]): r["new"] for r in rows}


def test_own_stem_does_not_add_to_a_neighbours_weight(spark):
    pool = [("ORG", "One", 1, "latin", "uz"), ("ORG", "Two two", 2, "latin", "uz"), ("ORG", "Three three three three", 4, "latin", "uz")]
    for own, weights in (("one", {"Two two": 2, "Three three three three": 4}), ("two Two", {"One": 1, "Three three three three": 4}), ("Three three three THREE", {"One": 1, "Two two": 2})):
        got = list(_draws(spark, pool, [(i, "ORG", own, "latin", "uz") for i in range(3_000)], bias=1.0).values())
        assert len(got) == 3_000 and set(got) == set(weights)
        assert all(abs(got.count(n) / 3_000 - w / sum(weights.values())) < 0.03 for n, w in weights.items()), own
    by_label = list(_draws(spark, pool, [(i, "ORG", "X", "latin", "uz") for i in range(3_000)], bias_by_label={"ORG": 2.0}).values())
    assert abs(by_label.count("One") / 3_000 - 1 / 21) < 0.02


def test_forms_limits_and_languages(spark):
    pool = [("ORG", f"Stem{i}", 1, "latin", "uz") for i in range(50)] + [("ORG", "Long long long", 3, "latin", "ru"), ("GEO", "Only", 1, "latin", "uz")]
    forms = _draws(spark, pool, [(i, "ORG", s, "latin", "uz") for i in range(40) for s in ("Anna", "ANNA", "anna")])
    assert len(forms) == 120 and all(len({forms[i, "ORG", s] for s in ("Anna", "ANNA", "anna")}) == 1 for i in range(40))
    # Stems that nothing can replace take no place of the document's.
    few = _draws(spark, pool, [(i, label, s, "latin", "uz") for i in range(40) for label, s in (("GEO", "Only"), ("ORG", "A"), ("ORG", "B"))], max_per_doc=2)
    assert set(few) == {(i, "ORG", s) for i in range(40) for s in "AB"}
    # The language is chosen before the number of words is looked at.
    assert _draws(spark, pool, [(1, "ORG", "Anna", "latin", "ru")], extra=1) == {}
    assert _draws(spark, pool, [(1, "ORG", "Anna", "latin", "ru")], extra=2) == {(1, "ORG", "Anna"): "Long long long"}


def test_replaced_mentions_keep_ending_and_case(spark):
    from spanframe.plans.pool_queries import replaced_mentions

    rows = replaced_mentions(spark, "/root/testdata/sf0.001").collect()
    ended = [r for r in rows if r["surface"] != r["stem"]]
    assert ended and all(r["new"].lower().endswith(("ning", "dagi", "dan", "da", "ga", "ka", "qa", "ni")) for r in ended)
    assert len({(r["id"], r["label"], r["surface"]) for r in rows}) == len(rows)


def test_match_case_of_small_letters(spark):
    row = spark.createDataFrame([("anna", "Anna", "A")], "a string, b string, c string")
    assert tuple(row.select(*(P.match_case(F.lit("Vali"), F.col(c)) for c in "abc")).first()) == ("vali", "Vali", "Vali")
