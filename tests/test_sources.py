"""Readers and writers, round trips and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from spanframe.operators.validation import check_pair, check_probabilities, check_window, entity_errors
from spanframe.sources import records as S


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "Ali Oʻzbek", [("NAME", 0, 3)], "s"), ("b", "", [], None)], S.RECORD)
    S.write_jsonl(df, str(tmp_path / "r"))
    assert sorted(map(str, S.read_jsonl(spark, str(tmp_path / "r")).collect())) == sorted(map(str, df.collect()))
    assert "Oʻzbek" in "".join(p.read_text() for p in (tmp_path / "r").glob("part*"))


@pytest.mark.parametrize("line", ["{", '{"hash":"a","text":"x"}\n\n{"hash":"b","text":"x"}', "[]", '{"hash":"","text":"x"}', '{"hash":"h","text":"x","entities":[{"label":"A","start":0,"end":5}]}', '{"hash":"a","text":"x"}\n{"hash":"a","text":"y"}'])
def test_strict_reader_refuses(spark, tmp_path, line):
    (tmp_path / "bad.jsonl").write_text(line + "\n")
    with pytest.raises(Exception, match=r"invalid record in .*bad.jsonl:[12]: |repeated hash"):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_reader_of_nothing_and_of_the_first(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError, match="no records"):
        S.read_jsonl(spark, str(tmp_path / "none.jsonl"))
    assert S.read_jsonl(spark, str(tmp_path / "none.jsonl"), strict=False).count() == 0
    (tmp_path / "five.jsonl").write_text("".join(f'{{"hash":"{c}","text":"x"}}\n' for c in "edcba"))
    assert sorted(r["hash"] for r in S.read_jsonl(spark, str(tmp_path / "five.jsonl"), limit=2).collect()) == ["d", "e"]


def test_an_unfinished_folder_is_written_again(spark, tmp_path):
    df = spark.range(3)
    at = tmp_path / "c" / S.cache_key({"v": 2})
    at.mkdir(parents=True)
    df.limit(1).write.mode("overwrite").parquet(str(at))
    (at / "_SUCCESS").unlink()
    assert S.cached(df, str(tmp_path / "c"), {"v": 2}).count() == 3


def test_tagged_tsv(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("Sentence\tTokenOrder\tToken\tNER_Tag\n1\t1\tAli\tB-PER\n1\t2\t\tO\n1\t3\tkeldi\t\n2\t1\tUy\tO\n1\t1\tEski\tO\n")
    got = S.read_tagged_tsv(spark, str(tmp_path / "g.tsv"), "Sentence", "Token", "NER_Tag").orderBy("sentence").collect()
    assert [(r["tokens"], r["tags"]) for r in got] == [(["Ali", "keldi"], ["B-PER", "O"]), (["Uy"], ["O"]), (["Eski"], ["O"])]


def test_conll(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Ali x B-PER\nkeldi y O\n\n\nUy z O\n")
    got = S.read_conll(spark, str(tmp_path / "c.txt")).orderBy("sentence").collect()
    assert [(r["tokens"], r["tags"]) for r in got] == [(["Ali", "keldi"], ["B-PER", "O"]), (["Uy"], ["O"])]


@pytest.fixture
def small_splits(spark):
    """Files in splits of 40 bytes, a partition each."""
    names = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "40"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def sentences(df):
    return [(r["tokens"], r["tags"]) for r in df.orderBy("file", "sentence").collect()]


def test_conll_in_many_splits(spark, tmp_path, small_splits):
    rnd = random.Random(3)
    want = []
    for name in ("a.txt", "b.txt"):
        lines = []
        for _ in range(40):
            own = [(f"w{rnd.randint(0, 10**rnd.randint(0, 9))}", rnd.choice(["O", "B-ORG"])) for _ in range(rnd.randint(1, 6))]
            want.append(([w for w, _ in own], [t for _, t in own]))
            lines += [f"{w} x {t}" for w, t in own] + [""] * rnd.randint(1, 3)
        (tmp_path / name).write_text("\r\n".join(lines))
    rows = S.read_conll(spark, str(tmp_path))
    assert rows.sparkSession.read.text(str(tmp_path)).rdd.getNumPartitions() > 14
    assert sentences(rows) == want


def test_tagged_tsv_in_many_splits(spark, tmp_path, small_splits):
    rnd = random.Random(4)
    lines, want, key = ["S\tN\tT\tG"], [], 0
    for _ in range(60):
        key = rnd.choice([key + 1, key + 1, key - 1])
        own = [(f"w{rnd.randint(0, 10**6)}", rnd.choice(["O", "B-PER", ""])) for _ in range(rnd.randint(1, 7))]
        lines += [line for w, t in own for line in (f"{key}\t1\t{w}\t{t}", *([f"{key}\t1\tshort"] * rnd.randint(0, 1)), *([f"{key}\t2\t\tO"] * rnd.randint(0, 1)))]
        want.append(([w for w, _ in own], [t or "O" for _, t in own]))
    (tmp_path / "g.tsv").write_text("\n".join(lines) + "\n")
    assert sentences(S.read_tagged_tsv(spark, str(tmp_path / "g.tsv"), "S", "T", "G", least=4)) == want
    assert S.read_conll(spark, str(tmp_path / "g.tsv")).count() == 1


def test_lines_of_errors_over_splits(spark, tmp_path, small_splits):
    good = "".join(f'{{"hash":"h{i}","text":"x","entities":[]}}\n' for i in range(9))
    (tmp_path / "r.jsonl").write_text(good)
    assert S.read_jsonl(spark, str(tmp_path / "r.jsonl")).count() == 9
    (tmp_path / "r.jsonl").write_text(good + "{\n")
    with pytest.raises(Exception, match=r"r.jsonl:10: "):
        S.read_jsonl(spark, str(tmp_path / "r.jsonl")).collect()


def test_bucket_and_cache(spark, tmp_path):
    df = spark.range(10).select("id", F.concat(F.lit("text "), "id").alias("text"))
    for _ in range(2):
        S.write_bucket(df, str(tmp_path / "b"), 5, ["id"], F.floor(F.col("id") / 4))
    assert {r["split"]: r["count"] for r in spark.read.parquet(str(tmp_path / "b")).groupBy("split").count().collect()} == {"train": 8, "validation": 2}
    assert S.cached(df, str(tmp_path / "c"), {"v": 1}).count() == S.cached(df.limit(1), str(tmp_path / "c"), {"v": 1}).count() == 10


def test_entity_errors(spark):
    cases = [([("ORG", 0, 2)], ""), ([("ORG", 0, 9)], "bad_bounds"), ([("X", 0, 1)], "bad_label"), ([("ORG", 1, 1)], "bad_bounds"), ([("ORG", 0, 2), ("GEO", 2, 3)], ""), ([("ORG", 0, 2), ("GEO", 1, 3)], "overlap"), ([("ORG", 0, 2), ("ORG", 0, 2)], "duplicate overlap"), ([], "")]
    df = spark.createDataFrame([(i, e) for i, (e, _) in enumerate(cases)], "i int, e array<struct<label:string,start:int,end:int>>")
    errors = entity_errors(F.col("e"), F.lit(5))
    for r in df.select("i", *(c.alias(n) for n, c in errors.items())).collect():
        assert {n for n in errors if r[n]} == set(cases[r["i"]][1].split())


def test_check_pair(spark):
    gold = spark.createDataFrame([("a", "abc"), ("b", "abc"), ("c", "abc"), ("d", "abc")], "hash string, text string")
    pred = spark.createDataFrame([("a", None, []), ("b", "zzz", []), ("c", "abc", [("ORG", 0, 9)]), ("e", "x", [])], "hash string, text string, entities array<struct<label:string,start:int,end:int>>")
    assert {r["hash"]: r["error"] for r in check_pair(gold, pred).collect()} == {"b": "text", "c": "spans", "d": "missing", "e": "extra"}


def test_settings():
    check_window(10, 0)
    check_probabilities({"a": 0.4, "b": 0.6}, 1.0)
    for bad in (lambda: check_window(3, 3), lambda: check_probabilities({"a": 0.4}, 1.0), lambda: check_probabilities({"a": 1.4})):
        with pytest.raises(ValueError):
            bad()
