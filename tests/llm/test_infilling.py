"""Fill-in-middle against a character-by-character version, and the automaton's functions against stepping."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from compare import difference
from pyspark.sql import functions as F
from test_operators import TEXTS, documents

from spanframe.llm import infilling as I

ALPHABET = list("aZqP<S>M \n.é漢🙂1") + ["<P>", "<S", "M>", "word"]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    named = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(named[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_functions_compose():
    rnd = random.Random(1)
    for _ in range(300):
        data = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))).encode()
        cuts = sorted(rnd.randint(0, len(data)) for _ in range(rnd.randint(0, 6)))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        functions = [I.chunk_function(p) for p in parts]
        at, whole = I.entries(functions)
        for state in range(4):
            now, units, hits = state, 0, 0
            for byte in data:
                kind = I._CLASS[byte]
                units, hits, now = units + int(I.UNIT[now, kind]), hits + int(I.HIT[now, kind]), int(I.STEP[now, kind])
            assert (whole[0][state], whole[1][state], whole[2][state], whole[3]) == (now, units, hits, len(data.decode()))
        # Composition is associative: any bracketing gives the same function.
        left = functions[0]
        for f in functions[1:]:
            left = I.then(left, f)
        right = functions[-1]
        for f in reversed(functions[:-1]):
            right = I.then(f, right)
        assert left == right == whole or len(functions) == 1 and left[1] == whole[1]
        assert at[0] == (I.FIRST, 0, 0)


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = I.fill_in_middle(documents(spark, texts, ids)).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=repr)
    assert got == sorted(((i, *brute(i, t)) for i, t in zip(ids, texts, strict=True)), key=repr)
    assert sorted(r["back"] for r in rows) == sorted(t or "" for t in texts)
    return rows


def test_short_texts(spark):
    rnd = random.Random(2)
    texts = TEXTS + ["<P>", "a<S", "x<M>y", "<<P", "P>"] + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60))) for _ in range(150)]
    rows = check(spark, texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_texts_of_many_chunks(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "漢字", "🙂", "é", " ", "\n", "<", ">", "42"]
    long_texts = ["".join(rnd.choice(words) + " " for _ in range(60_000)) for _ in range(12)]
    edge = "x" * (I.CHUNK - 2) + "<P>" + "y" * 10  # a marker over a chunk's end
    check(spark, [*long_texts, edge, "a" * (3 * I.CHUNK), "é" * I.CHUNK, "é" + "b." * I.CHUNK, "short"])


def test_repeats_and_null_ids(spark):
    long_text = "one two. " * 20_000
    check(spark, [long_text, long_text, long_text, "a b", "a b", None, "c d e"], ids=[5, 5, None, 7, 7, 7, None])


def test_very_long_text(spark):
    check(spark, ["Ten million letters, in words. " * 330_000])


def test_empty_table(spark):
    assert I.fill_in_middle(documents(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    assert difference(spark, I.op12_fill_in_middle, I.OP12_SQL, f"/root/testdata/{sf}") is None
