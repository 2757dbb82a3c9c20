"""Surfaces at their first free places against a search that starts anew each time; quotas."""

import random
import re

from spanframe.operators import alignment as A
from spanframe.operators.sampling import allocated, quotas

LABELS = ("ORG", "NAME", "GEO")


def brute(text, items):
    fold = lambda t: re.sub("[ʻʼ’‘`´′]", "'", t)
    used = []
    for surface, label in items:
        surface, label = (surface or "").strip(" "), (label or "").upper()
        if not surface or label not in LABELS:
            continue
        for hay, needle in ((text, surface), (fold(text), fold(surface)), (fold(text).lower(), fold(surface).lower())):
            free = [i for i in range(len(text)) if hay.startswith(needle, i) and all(i >= e or i + len(needle) <= s for s, e, _ in used)]
            if free:
                used.append((free[0], free[0] + len(needle), label))
                break
    return sorted(used)


def test_surfaces(spark):
    rnd = random.Random(4)
    rows = [(0, "Bank Bank Oʻzbekistonda Ali bor", [("Bank", "ORG"), ("O'zbekiston", "GEO"), ("Bank", "org"), ("ali", "NAME"), ("bor", "FOO"), ("yo'q", "GEO"), (" ", "ORG"), (None, "ORG"), ("x", None)]), (1, None, [("a", "ORG")]), (2, "a", None), (3, "", [])]
    for i in range(4, 200):
        text = "".join(rnd.choice(["a", "A", "b", "'", "ʻ", " ", "ab", "aba"]) for _ in range(rnd.randint(0, 25)))
        rows.append((i, text, [("".join(rnd.choice("aAb'’") for _ in range(rnd.randint(0, 4))), rnd.choice([*LABELS, "X"])) for _ in range(rnd.randint(0, 9))]))
    df = spark.createDataFrame(rows, "doc_id long, text string, items array<struct<text:string,label:string>>")
    for r in A.align_surfaces(df, LABELS).collect():
        assert [(s["start"], s["end"], s["type"]) for s in r["spans"]] == brute(r["text"] or "", [(x["text"], x["label"]) for x in r["items"] or []])


def test_one_surface_many_times():
    """Linear: each search goes on from the last."""
    n = 100_000
    assert A.placed("Ali " * n, [("Ali", "NAME")] * n, LABELS)[-1] == (4 * n - 4, 4 * n - 1, "NAME")


def test_allocated(spark):
    for weights in ({"a": 0.5, "b": 0.5}, {"a": 0.35, "b": 0.25, "c": 0.25, "d": 0.15}, {"x": 1.0}):
        rows = spark.createDataFrame([(k, w * 8) for k, w in weights.items()], "source string, w double")
        for size in (5, 101, 0):
            assert {r["source"]: r["quota"] for r in allocated(rows, "source", "w", size).collect()} == quotas(weights, size)
