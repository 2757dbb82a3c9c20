"""The pipeline's stages on small documents, each against what it should keep."""

from __future__ import annotations

import random

import corpus_pipeline as P
import pytest
from test_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, lang, n):
    words = {"xx": ["kala", "kuta", "mala", "naka", "taka", "pola"], "yy": ["strom", "brick", "ghost", "frond", "clump", "twist"]}[lang]
    return " ".join(rnd.choice(words) + rnd.choice(["", "s", "ri", "to"]) + str(rnd.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [(i, prose(rnd, "xx" if i % 2 else "yy", rnd.randint(40, 120)), "xx" if i % 2 else "yy", "s", 0) for i in range(60)]
    passage = prose(rnd, "xx", 90)
    out += [(100 + i, f"{prose(rnd, 'xx', 60)} {passage} {prose(rnd, 'xx', 60)}", "xx", None, None) for i in range(3)]
    near = out[5][1].split(" ")
    near[7] = "kala9"
    out += [(200, " ".join(near), None, "s", 1), (201, out[6][1], "yy", "s", 1), (202, out[6][1], "yy", "s", 1), (202, out[6][1], "yy", "s", 1)]
    return out + [(300, None, "xx", "s", None), (301, "", None, None, 0), (302, " 12 ?! ", "yy", "s", 7), (None, prose(rnd, "yy", 50), None, "s", 3)]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = P.language_id(spark, docs, "")
    assert kept.columns == list(P.COLUMNS)
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    assert ids == sorted((r[0] if r[0] is not None else -1) for r in rows if r[0] not in (300, 301, 302))

    unique = P.near_duplicates(spark, kept, "").collect()
    texts = {r[0]: r[1] for r in rows if r[0] in ids}
    want = {c for _, _, c in brute_components(list(texts.values()), list(texts), 5, 80, 100)}
    assert sorted(r["doc_id"] for r in unique if r["doc_id"] is not None) == sorted(want) and sum(r["doc_id"] is None for r in unique) == 1
    assert not {200, 201, 202} & want

    cut = {r["doc_id"]: r for r in P.substring_dedup(spark, spark.createDataFrame(unique, SCHEMA), "").collect()}
    assert set(cut) == {r["doc_id"] for r in unique}
    before = {r["doc_id"]: r["text"] for r in unique}
    assert {i for i in cut if cut[i]["text"] != before[i]} == {101, 102}
    assert all(cut[i]["n_chars"] == len(cut[i]["text"]) < len(before[i]) for i in (101, 102))

    packed = P.best_fit_packing(spark, spark.createDataFrame(list(cut.values()), SCHEMA), "").collect()
    assert {r["doc_id"] for r in packed} == set(cut)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    from spanframe.llm.common import divided, stored

    rnd = random.Random(5)
    texts = [rnd.randbytes(4_000).hex() + f" {i} a b c d e" for i in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 290], "en", "s", 10) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = P.near_duplicates(spark, stored(docs, "docs"), "")
        store = spark.sparkContext._jsc.sc().statusStore()

        def shuffled():
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            return store.executorSummary("driver").totalShuffleWrite()

        before = shuffled()
        assert sorted(r.doc_id for r in stored(kept, "kept").select("doc_id").collect()) == list(range(290))
        assert shuffled() - before < 600_000  # the texts have 2.3 MB, as hexadecimal digits about half in a shuffle
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    keys = spark.createDataFrame([(7,), (None,), (-5,)], "k long")
    rows = spark.range(-3_000, 3_000).union(spark.createDataFrame([(None,)], "id long"))
    sure, rest = (sorted((r.id for r in x.collect()), key=str) for x in divided(rows, "id", keys))
    assert len(sure) + len(rest) == 6_001 and {7, -5, None} <= set(rest) and len(rest) < 20


def test_near_duplicates_drops_what_earlier_stages_left_in_workers():
    import pyarrow as pa
    from spanframe.llm import common, jaccard

    common.per_worker("left over", 1, lambda: bytearray(10))
    out = list(jaccard._parts(3, 0)(iter(pa.table({"id": [1], "text": ["a b c d"]}).to_batches())))
    assert len(out) == 1 and not common._WORKER
