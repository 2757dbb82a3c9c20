"""Ordered answers with attempts, and the chain from prompts to spans."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from spanframe.operators import prompting as L


def test_every_third_fails(spark):
    df = spark.range(0, 100, 1, 2).select("id", F.when(F.col("id") != 50, F.concat(F.lit("p"), "id")).alias("prompt"), F.lit(1).alias("raw_"))

    def call(prompt):
        if int(prompt[1:]) % 3 == 0:
            raise ValueError(prompt)
        return prompt.upper()

    rows = L.answered(df, call, attempts=2, at_once=4).collect()
    assert [r["id"] for r in rows] == list(range(100))
    for r in rows:
        if r["id"] == 50:
            assert r["raw"] is None and r["error"] is None
        elif r["id"] % 3 == 0:
            assert r["raw"] is None and r["error"] == f"ValueError: p{r['id']}"
        else:
            assert r["raw"] == f"P{r['id']}" and r["error"] is None


def test_three_attempts(spark):
    seen: dict[str, int] = {}

    def call(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        if seen[prompt] < int(prompt):
            raise TimeoutError("late")
        return str(seen[prompt])

    rows = L.answered(spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "prompt string").coalesce(1), call, at_once=1).collect()
    assert [(r["raw"], r["error"]) for r in rows] == [("1", None), ("2", None), ("3", None), (None, "TimeoutError: late")]


def test_chain(spark):
    docs = spark.createDataFrame([(1, "Ali Toshkentda, Ali uyda"), (2, "hech kim"), (3, "Vali down"), (4, None)], "doc_id long, text string")

    def call(prompt):
        text = prompt.rpartition("Text: ")[2].removesuffix("\nAnswer:")
        if "down" in text:
            raise ConnectionError("refused")
        names = ", ".join(f'{{"text": "{w}", "label": "name"}}' for w in re.findall("[A-Z][a-z]+", text))
        return f'```json\n{{"entities": [{names}]}}\n```'

    got = {r["doc_id"]: r for r in L.extracted(docs, call, ("NAME",)).collect()}
    assert [(s["start"], s["end"], s["type"]) for s in got[1]["spans"]] == [(0, 3, "NAME"), (4, 14, "NAME"), (16, 19, "NAME")]
    assert got[2]["spans"] == [] and got[2]["error"] is None
    assert got[3]["spans"] is None and got[3]["error"] == "ConnectionError: refused"
    assert got[4]["spans"] in (None, [])


def test_errors_dumped(spark):
    kind = "doc_id long, start long, end long, label string"
    gold = spark.createDataFrame([(1, 0, 3, "NAME"), (1, 0, 3, "NAME"), (2, 0, 2, "GEO")], kind)
    pred = spark.createDataFrame([(1, 0, 3, "NAME"), (2, 0, 2, "ORG"), (3, 5, 6, "ORG")], kind)
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(x) for x in r["missed"]], [tuple(x) for x in r["spurious"]], r["text"]) for r in L.errors_dumped(gold, pred, docs).collect()}
    assert got == {2: ([(0, 2, "GEO")], [(0, 2, "ORG")], "b"), 3: ([], [(5, 6, "ORG")], "c")}
