"""Assembled records, augmentation and reports against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from spanframe.operators import assembly as B
from spanframe.operators import augmentation as U
from spanframe.operators import reports as R
from spanframe.operators.corpus import inserted
from spanframe.operators.ordered import capped
from spanframe.operators.sampling import subset_seed
from spanframe.operators.validation import check_tags

RECORD = "id long, text string, entities array<struct<label:string,start:int,end:int>>"


def test_assembled(spark):
    given = [
        ("a", "uz", 1, ["Ali", ",", "(", "Toshkent", ")", "keldi", "."], ["B-PER", "O", "B-LOC", "I-LOC", "I-LOC", "O", "O"]),
        ("a", "uz", 2, ["'", "ning", "Olma"], ["B-PER", "I-PER", "B-FRUIT"]),
        ("a", "uz", 3, ["Ona", "Vatan"], ["I-LOC", "I-LOC"]),
        ("b", "ru", 7, [], []),
    ]
    rows = spark.createDataFrame(given, "source string, lang string, sentence long, tokens array<string>, tags array<string>")
    out = {(r["source"], r["text"]): r for r in B.assembled(rows, {"PER": "NAME", "LOC": "GEO"}, 2).collect()}
    first = "Ali, (Toshkent) keldi.\n' ning Olma"
    assert set(out) == {("a", first), ("a", "Ona Vatan"), ("b", "")}
    got = out["a", first]
    assert [(e["label"], first[e["start"] : e["end"]]) for e in got["entities"]] == [("NAME", "Ali"), ("GEO", "Toshkent")]
    assert got["n_dropped"] == 1 and got["lang"] == "uz" and got["hash"] == hashlib.sha1(f"a:1:{first}".encode()).hexdigest()
    assert [tuple(e) for e in out["a", "Ona Vatan"]["entities"]] == [("GEO", 0, 9)]
    assert B.assembled(rows.limit(0), {"PER": "NAME"}).count() == 0


def test_bad_edges(spark):
    cases = [("Ali keldi", [("NAME", 0, 3)], False), ("Ali keldi", [("NAME", 0, 2)], True), ("Ali keldi", [("NAME", 0, 4)], True), ("Ali", [("NAME", 1, 3)], True), ("Ali", [("NAME", 0, 9)], True), ("Ali", [], False)]
    rows = spark.createDataFrame([(i, t, e) for i, (t, e, _) in enumerate(cases)], RECORD)
    got = dict(rows.select("id", B.bad_edges(F.col("text"), F.col("entities"))).collect())
    assert got == {i: bad for i, (_, _, bad) in enumerate(cases)}


def test_chunks_move_spans(spark):
    texts = [("Алишер Навоий шаҳрида яшайди ва ишлайди", "Алишер Навоий"), ("Shahar va qishloq, Choʻpon ota bilan keldi", "Choʻpon ota"), ("123 456", None), ("", None), (None, None)]
    data = [(i, t, [("NAME", t.index(s), t.index(s) + len(s))] if s else []) for i, (t, s) in enumerate(texts * 20)]
    rows = spark.createDataFrame(data, RECORD)
    for to, able in (("latin", 0), ("cyrillic", 1)):
        got = U.transliterated_chunks(rows, "id", to, 5, whole=0.2).collect()
        changed = [r for r in got if r["new_text"] is not None]
        assert len(got) == len(data) and {r["id"] % 5 for r in changed} == {able} and len({r["new_text"] for r in changed}) > 3
        for r in changed:
            e, old = r["new_entities"][0], r["entities"][0]
            before, after = r["text"][: old["start"]], r["text"][old["end"] :]
            assert len(r["new_text"][: e["start"]].split()) == len(before.split()) and len(r["new_text"][e["end"] :].split()) == len(after.split())
            assert not r["new_text"][e["start"]].isspace() and not r["new_text"][e["end"] - 1].isspace()


def test_augmented_order_and_spans(spark):
    text = "Ali Toshkent shahrida"
    rows = spark.createDataFrame([(i, text, [("NAME", 0, 3), ("GEO", 4, 12)]) for i in range(40)], RECORD)
    same = U.augmented(rows, "id", 3, {}).collect()
    assert all(r["text"] == text and not r["augmented"] for r in same)
    new = rows.withColumn("surfaces", F.array(F.lit("Vali Karim"), F.lit(None).cast("string")))
    for r in U.augmented(new, "id", 3, {"upper": 1.0}).collect():
        assert r["augmented"] and [r["text"][e["start"] : e["end"]] for e in r["entities"]] == ["VALI KARIM", "TOSHKENT"]
    both = U.augmented(rows, "id", 3, {}, to_cyrillic=1.0).collect()
    assert any("Али" in r["text"] for r in both) and all(r["augmented"] for r in both)


def test_inserted_words(spark):
    for r in spark.range(50).select(inserted(F.split(F.lit("a b c d"), " "), F.split(F.lit("x y z"), " "), F.rand(1), F.rand(2), F.rand(3)).alias("t")).collect():
        w = r["t"].split()
        other = [i for i, x in enumerate(w) if x in "xyz"]
        assert [x for x in w if x in "abcd"] == list("abcd") and w[0] == "a" and w[-1] == "d"
        assert 1 <= len(other) <= 3 and other == list(range(other[0], other[-1] + 1)) and "".join(w[i] for i in other) in "xyz"


def test_settings():
    assert R.parse_scales(["ORG=1.2", " GEO =0.9"]) == {"ORG": 1.2, "GEO": 0.9}
    for bad in ("ORG", "=2", "ORG="):
        with pytest.raises(ValueError):
            R.parse_scales([bad])
    check_tags(["O", "B-X", "I-X"], ["X"])
    with pytest.raises(ValueError, match="I-X"):
        check_tags(["O", "B-X"], ["X"])
    assert (subset_seed(5, "train"), subset_seed(5, "val")) == (5, 6)
    assert (B.subset_size(95, "train"), B.subset_size(95, "val"), B.subset_size(3, "val")) == (95, 9, 1)


def test_caps_keep_the_group_of_null(spark):
    rows = spark.createDataFrame([(i, s) for i in range(10) for s in ("a", None)], "id long, source string")
    got = capped(rows, F.lit(1), F.lit(4), ["id"], F.floor(F.col("id") / 3), ["source"]).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 4, None: 4}


def test_mix(spark):
    data = [(f"h{i}", "t", [("ORG", 0, 1)] * (i % 3), ("a", "b", None)[i % 3]) for i in range(90)]
    rows = spark.createDataFrame(data, "hash string, text string, entities array<struct<label:string,start:int,end:int>>, source string")
    got = B.mixed(rows, {"b": 10}, 1, rows.where("source = 'a'"), 3).collect()
    count = {s: sum(r["source"] == s for r in got) for s in ("a", "b", None)}
    assert count == {"a": 30 + 90, "b": 10, None: 30}
    assert sum(r["hash"].endswith("-r2") for r in got) == 30
    assert {r["hash"] for r in B.mixed(rows, {}, 1).collect()} == {h for h, *_ in data}
