"""Golden rows and properties of the text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanframe.functions import constants as K
from spanframe.functions import text as T
from spanframe.functions import translit as X

GOLDEN = [
    ("Тошкент вилояти", [("GEO", 0, 7)], "latin", "Toshkent viloyati", [("GEO", 0, 8)]),
    ("O'zbekiston Respublikasi", [("GEO", 0, 11)], "cyrillic", "Ўзбекистон Республикаси", [("GEO", 0, 10)]),
    ("Farg'ona shahrida Aziz bilan", [("GEO", 0, 8), ("NAME", 18, 22)], "cyrillic", "Фарғона шаҳрида Азиз билан", [("GEO", 0, 7), ("NAME", 16, 20)]),
    ("ШАҲАР", [], "latin", "SHAHAR", []),
    ("shahar", [("GEO", 1, 6)], "cyrillic", None, None),
]


def rows(spark, values):
    return spark.createDataFrame([(v,) for v in values], "t string")


@pytest.mark.parametrize("text,spans,to,want,moved", GOLDEN)
def test_transliterated_records(spark, text, spans, to, want, moved):
    df = spark.createDataFrame([(text, spans)], "text string, entities array<struct<label:string,start:int,end:int>>")
    out = df.select(X.transliterate(F.col("text"), F.col("entities"), to).alias("o")).first()["o"]
    assert out["text"] == want
    assert (moved is None and out["entities"] is None) or [tuple(e) for e in out["entities"]] == moved


def random_texts(n=300):
    rnd = random.Random(4)
    alphabet = list("oOgGaz'`’ʻʼ аобы. 1½²🙂­​字é-")
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_apostrophes_by_character(spark):
    def rule(t):
        out = []
        for i, c in enumerate(t):
            before, after = t[i - 1] if i else "", t[i + 1] if i + 1 < len(t) else ""
            if c in K.APOSTROPHES and before.isalpha():
                out.append(K.TURNED_COMMA if before in "oOgG" else K.MODIFIER_APOSTROPHE if after.isalpha() else c)
            else:
                out.append(c)
        return "".join(out)

    got = rows(spark, random_texts()).select("t", T.unify_apostrophes(F.col("t")).alias("o"), T.prepare(F.col("t")).alias("p")).collect()
    assert all(r["o"] == rule(r["t"]) and len(r["p"]) == len(r["t"]) for r in got)
    words = ["Oʻzbekiston", "maʼno", "gʻoya 'qavs'"]
    assert [r["p"] for r in rows(spark, words).select(T.prepare(F.col("t")).alias("p")).collect()] == words


def test_canonical_words_by_character(spark):
    import unicodedata

    def rule(t):
        out, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and t[j].isalnum():
                j += 1
            if j > i:
                out.append((t[i:j], i, j))
                i = j
                continue
            if not t[i].isspace() and unicodedata.category(t[i]) != "Cf":
                out.append((t[i], i, i + 1))
            i += 1
        return out

    for r in rows(spark, random_texts()).select("t", T.canonical_words(F.col("t")).alias("w")).collect():
        assert [tuple(w) for w in r["w"]] == rule(r["t"])


def test_chunks_join_again(spark):
    rnd = random.Random(9)
    texts = ["\n".join("x" * rnd.randint(0, 9) for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    for r in rows(spark, texts).select("t", T.split_chunks(F.col("t"), 12).alias("c")).collect():
        assert "\n".join(r["c"]) == r["t"]
        assert all(len(c) <= 13 or "\n" not in c for c in r["c"])


def test_nulls_and_empty(spark):
    for f in (T.prepare, T.detect_language, T.corpus_script, T.looks_clean, T.canonical_words, X.corpus_latin_to_cyrillic, X.cyrillic_to_latin, X.latin_to_cyrillic):
        assert len(rows(spark, [None, "", " "]).select(f(F.col("t"))).collect()) == 3


def test_visible_edges(spark):
    left, right = T.visible_edges(F.col("t"))
    got = rows(spark, ["​ab­", "​", "a"]).select(left.alias("l"), right.alias("r")).collect()
    assert [tuple(x) for x in got] == [(1, 1), (1, 0), (0, 0)]


def test_trimmed_tail(spark):
    assert rows(spark, ["Ali (shoir)", "Ali ."]).select(T.trim_parenthesis(F.col("t"))).first()[0] == "Ali"
    assert re.sub(r"\s", "", K.EN_MARKS)


def test_offsets_composition_stems_and_rebuilding(spark):
    from spanframe.operators.pool import match_case, rebuilt, transliterated_stem

    df = spark.createDataFrame([(" ab  c", [(0, 3), (3, 5), (5, 6)])], "t string, o array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(T.trim_offsets(F.col("t"), F.col("o"))).first()[0]] == [(1, 3), (5, 5), (5, 6)]
    assert [r[0] for r in rows(spark, ["é ​x", None]).select(T.composed(F.col("t"))).collect()] == ["é x", None]
    stems = rows(spark, ["Toshkent", "Washington", "Navoiy"]).select(transliterated_stem(F.col("t"), "cyrillic")).collect()
    assert [r[0] for r in stems] == ["Тошкент", None, "Навоий"]
    one = spark.createDataFrame([("Ali va Vali keldi", [("NAME", 0, 3), ("NAME", 7, 11)], ["Salim", None])], "t string, e array<struct<label:string,start:int,end:int>>, s array<string>")
    out = one.select(rebuilt(F.col("t"), F.col("e"), F.col("s")).alias("r")).first()["r"]
    assert out["text"] == "Salim va Vali keldi" and [tuple(e) for e in out["entities"]] == [("NAME", 0, 5), ("NAME", 9, 13)]
    assert rows(spark, ["ALI"]).select(match_case(F.lit("Vali"), F.col("t"))).first()[0] == "VALI"


@pytest.mark.parametrize("to", ["latin", "cyrillic"])
def test_spans_by_runs_are_those_by_letters(spark, to):
    rnd = random.Random(8)
    letters = list("yYoOshcCtgʻ'’aeEzwqяЯеЕёшЮЪьцўҒ ²Ⅷ1.-_\n🙂ßİKſéǅ")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + [None, "", "ЕЁ Yo", "SHAHAR"]
    spans = [[("GEO", *sorted(rnd.sample(range(28), 2))) if rnd.random() < 0.9 else ("GEO", None, 2) for _ in range(rnd.randint(0, 2))] if rnd.random() < 0.95 else None for _ in texts]
    df = spark.createDataFrame(list(zip(texts, spans, strict=True)), "text string, entities array<struct<label:string,start:int,end:int>>")
    moved = X.moves(T.unify_apostrophes(F.col("text")), to).alias("m")
    for r in df.select("entities", moved, X.transliterate(F.col("text"), F.col("entities"), to).alias("o")).collect():
        at = lambda i, m=r["m"]: None if i is None or m["at"] is None or i >= len(m["at"]) else m["at"][i]
        want = None if r["entities"] is None else [(e["label"], at(e["start"]), at(e["end"])) for e in r["entities"]]
        reason = "inside a pair" if any(None in e for e in want or ()) else "vanished" if any(a >= b for _, a, b in want or ()) else None
        assert r["o"]["reason"] == reason
        assert r["o"]["text"] == (None if reason else r["m"]["text"])
        assert (None if r["o"]["entities"] is None else [tuple(e) for e in r["o"]["entities"]]) == (None if reason else want)


def test_transliterated_records_are_not_dealt(spark):
    from spanframe.plans.text_queries import transliterate_records

    assert "Exchange" not in transliterate_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
