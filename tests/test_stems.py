"""Stems, pools and their files against rules applied mention by mention."""

import json
from collections import Counter

from spanframe.operators import stems as S

MENTION = "label string, surface string, lang string, ord long"


def known(spark, *surfaces):
    return S.learned(spark.createDataFrame([(s,) for s in surfaces], "surface string"))


def split(spark, dictionary, *surfaces):
    rows = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    return {r["surface"]: (r["stem"], r["ending"]) for r in S.split_endings(rows, dictionary).collect()}


def test_endings_by_look_up(spark):
    by = known(spark, "Toshkent", "Telegram", "Toshkent davlat universiteti", "Тошкент", "x", "два words")
    got = split(spark, by, "Toshkentda", "Kanada", "Telegram'da", "London universitetida", "Saudiya Arabistoni", "Sinvarning", "Govinda", "Тошкентнинг", "Кананинг", "TOSHKENTGA", "Anning", "Big Anning", "universitetida", "Toshkent")
    assert got == {
        "Toshkentda": ("Toshkent", "da"), "Kanada": ("Kanada", ""), "Telegram'da": ("Telegram", "'da"), "London universitetida": ("London universiteti", "da"), "Saudiya Arabistoni": ("Saudiya Arabistoni", ""),
        "Sinvarning": ("Sinvar", "ning"), "Govinda": ("Govinda", ""), "Тошкентнинг": ("Тошкент", "нинг"), "Кананинг": ("Кана", "нинг"), "TOSHKENTGA": ("TOSHKENT", "GA"), "Anning": ("Anning", ""), "Big Anning": ("Big Anning", ""),
        "universitetida": ("universitetida", ""), "Toshkent": ("Toshkent", ""),
    }


def test_a_round_uses_what_the_last_one_learned(spark):
    rows = lambda *s: spark.createDataFrame([("GEO", x, "uz", i) for i, x in enumerate(s)], MENTION)
    pool = S.build_pool(rows("Nevada", "Nevadada"), 1)
    assert split(spark, pool.known, "Xivada", "Nevadaga") == {"Xivada": ("Xivada", ""), "Nevadaga": ("Nevada", "ga")}
    more = S.relearned(pool, rows("Xiva", "Katta bozor"))
    assert split(spark, more.known, "Xivada", "Eski bozorda") == {"Xivada": ("Xiva", "da"), "Eski bozorda": ("Eski bozor", "da")}
    assert {r["stem"] for r in more.entries.collect()} == {"Nevada"}
    again = S.build_pool(rows("Xivada", "Xivaga"), 2, known=more.known)
    assert [(r["stem"], r["label"]) for r in again.entries.collect()] == [("Xiva", "GEO")]


def test_build(spark):
    surfaces = [("GEO", "Buxoro"), ("GEO", "Buxoroda"), ("ORG", "Buxoro"), ("GEO", "BUXORO"), ("GEO", "BUXORO"), ("GEO", "BUXORO"), ("NAME", "Prezident Shavkat Aliyev"), ("NAME", "Prezident Shavkat Aliyev"), ("NAME", "shavkat aliyev"), ("NAME", "shavkat aliyev"), ("GEO", "Yaponlar"), ("GEO", "Yaponlar"), ("ORG", "Davlat rahbari"), ("ORG", "Davlat rahbari"), ("ORG", "@junk"), ("ORG", "@junk"), ("ORG", None), ("GEO", "Once"), ("ORG", "Microsoft"), ("ORG", "Microsoft"), ("GEO", "Москва"), ("GEO", "Москва")]
    rows = spark.createDataFrame([(label, s, "ru" if s == "Москва" else "uz", i) for i, (label, s) in enumerate(surfaces)], MENTION)
    texts = spark.createDataFrame([("prezident davlat rahbari " * 3,), ("Shavkat Buxoro " * 9,), (None,)], "text string")
    pool = S.build_pool(rows, 2, 0.8, reference_texts=texts, transliterate=True, source="here")
    got = {(r["label"], r["stem"], r["n_words"], r["script"], r["lang"], r["source"]) for r in pool.entries.collect()}
    assert got == {
        ("GEO", "Buxoro", 1, "latin", "uz", "here"), ("GEO", "Бухоро", 1, "cyrillic", "uz", "here"), ("NAME", "Shavkat Aliyev", 2, "latin", "uz", "here"), ("NAME", "Шавкат Алиев", 2, "cyrillic", "uz", "here"),
        ("ORG", "Microsoft", 1, "latin", "uz", "here"), ("GEO", "Москва", 1, "cyrillic", "ru", "here"), ("GEO", "Moskva", 1, "latin", "ru", "here"),
    }
    stats = {(r["label"], r["slice"]): r["n"] for r in S.pool_stats(pool.entries).collect()}
    want = Counter()
    for label, _, _, script, lang, _ in got:
        want[label, "total"] += 1
        want[label, f"{lang}-{script[:3]}"] += 1
    assert stats == dict(want)
    whole = S.build_pool(rows, 2, 0.8, split=False)
    assert ("GEO", "BUXORO") in {(r["label"], r["stem"]) for r in whole.entries.collect()}


def test_empty(spark):
    pool = S.build_pool(spark.createDataFrame([], MENTION), 1, transliterate=True)
    assert pool.entries.count() == 0 and pool.known.count() == 0


def test_merge_and_files(spark, tmp_path):
    entry = lambda *rows: spark.createDataFrame(rows, S.ENTRY)
    a = S.MentionPool(entry(("GEO", "Xiva", 1, "latin", "uz", "a"), ("ORG", "Bank", 1, "latin", "uz", "a")), known(spark, "Xiva", "Bank"))
    b = S.MentionPool(entry(("GEO", "XIVA", 1, "latin", "ru", "b"), ("GEO", "Хива", 1, "cyrillic", "ru", "b"), ("ORG", "Milliy bank", 2, "latin", "uz", "b")), known(spark, "Milliy bank"))
    both = S.merged(a, b)
    want = {("GEO", "Xiva", "a"), ("ORG", "Bank", "a"), ("GEO", "Хива", "b"), ("ORG", "Milliy bank", "b")}
    assert {(r["label"], r["stem"], r["source"]) for r in both.entries.collect()} == want
    assert {(r["kind"], r["key"]) for r in both.known.collect()} == {("stem", "xiva"), ("stem", "bank"), ("stem", "milliy bank"), ("last", "bank")}
    at = str(tmp_path / "pool")
    S.write_pool(both.entries, at)
    back = S.read_pool(spark, at)
    assert {(r["label"], r["stem"], r["source"]) for r in back.entries.collect()} == want
    assert {(r["kind"], r["key"]) for r in back.known.collect()} == {("stem", "xiva"), ("stem", "bank"), ("stem", "milliy bank"), ("stem", "хива"), ("last", "bank")}
    lines = [line for p in sorted((tmp_path / "pool").glob("part*")) for line in p.read_text().splitlines()]
    assert lines == sorted(lines, key=lambda x: x) and len(lines) == 4
    (tmp_path / "twice").mkdir()
    (tmp_path / "twice" / "a.txt").write_text(lines[0] + "\n\n" + lines[0].replace('"a"', '"z"') + "\n")
    assert [r["source"] for r in S.read_pool(spark, str(tmp_path / "twice")).entries.collect()] == [json.loads(lines[0])["source"]]
