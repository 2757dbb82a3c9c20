"""Requests answered by count or time on a stream of files."""

import json
import time

import pytest

from spanframe.streaming import coalescing as C


@pytest.fixture
def stream(spark, tmp_path):
    """(add(requests), rows()) of a running query of at most three requests a batch and a wait of four seconds."""
    key, value = C.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    (tmp_path / "in").mkdir()
    requests = spark.readStream.schema("request string, items array<string>").json(str(tmp_path / "in"))

    def upper(items):
        return [f"{len(items)}:{x.upper()}" for x in items]

    query = C.answered_together(requests, upper, 3, 4.0).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    turn = [0]

    def add(*rows):
        turn[0] += 1
        at = tmp_path / f"{turn[0]}.tmp"
        at.write_text("".join(json.dumps({"request": q, "items": i}) + "\n" for q, i in rows))
        at.rename(tmp_path / "in" / f"{turn[0]}.json")

    yield add, lambda: [r.asDict() for r in spark.sql("select * from answers").collect()], query
    query.stop()
    spark.conf.set(key, before)


def until(rows, n, seconds=60):
    end = time.time() + seconds
    while len(rows()) < n and time.time() < end:
        time.sleep(0.3)
    return rows()


def test_by_count_then_by_time(stream):
    add, rows, query = stream
    add(("a", ["x", "y"]), ("b", []), ("c", ["z"]), ("d", ["u"]))
    got = until(rows, 3)
    assert {r["request"]: (r["batch"], r["size"], r["answers"]) for r in got} == {"a": (0, 3, ["3:X", "3:Y"]), "b": (0, 3, []), "c": (0, 3, ["3:Z"])}
    got = until(rows, 4)  # no third request comes: d goes when it has waited
    assert [(r["batch"], r["size"], r["answers"]) for r in got if r["request"] == "d"] == [(1, 1, ["1:U"])]
    add(("e", ["p"]), ("f", ["q"]))
    add(("e", ["p"]))
    got = until(rows, 7)
    assert sorted((r["request"], r["answers"][0]) for r in got if r["batch"] > 1 and r["size"] == 3) in ([], [("e", "3:P"), ("e", "3:P"), ("f", "3:Q")])
    assert sorted(r["request"] for r in got) == ["a", "b", "c", "d", "e", "e", "f"] and query.exception() is None
