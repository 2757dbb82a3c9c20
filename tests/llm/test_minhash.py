"""MinHash components against all pairs, and the signatures against their definition."""

from __future__ import annotations

import random

import numpy as np
import pytest
from compare import difference
from test_operators import documents

from spanframe.llm import minhash as M
from spanframe.llm.shingles import shingle_hashes


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")


def brute(texts, ids, k, num, den):
    """(id, size, component, kept) of each row."""
    sets = []
    for t in texts:
        w = [x for x in words_of(t) if x]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = min((least.get(r), x), key=lambda v: (v is None, v or 0)) if r in least else x
    return sorted(((x, len(sets[i]), least[root(i)], x == least[root(i)]) for i, x in enumerate(ids)), key=repr)


def got(spark, texts, ids, k, num, den):
    return sorted((tuple(r) for r in M.near_duplicates(documents(spark, texts, ids).repartition(3), k, num, den).collect()), key=repr)


def family(rnd, n, copies, changes):
    """Copies of n words, each with some words changed."""
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        own = base[:]
        for _ in range(rnd.randint(0, changes)):
            own[rnd.randrange(n)] = f"x{rnd.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("k", "num"), [(4, 80), (5, 80)])
def test_components(spark, k, num):
    rnd = random.Random(k)
    texts = [None, "", " \n ", "One", "one", "two words", "TWO\twords", "a b c d", "a b c d e", "漢字 é x y"]
    for n, copies, changes in ((6, 6, 1), (12, 10, 2), (60, 25, 6), (300, 12, 9), (40, 60, 1), (5_000, 3, 20)):
        texts += family(rnd, n, copies, changes)
    texts += texts[20:30]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    assert got(spark, texts, ids, k, num, 100) == brute(texts, ids, k, num, 100)


def test_bucket_of_several_components(spark):
    """Classes that share buckets with the least one but link with others only; three families over one long passage."""
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(200)]
    texts = []
    for _ in range(6):
        own = [f"o{rnd.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(4):
            own[rnd.randrange(60)] = f"p{rnd.randint(0, 10**6)}"
            texts.append(" ".join(common + own))
    rnd.shuffle(texts)
    ids = list(range(len(texts)))
    want = brute(texts, ids, 4, 80, 100)
    assert len({r[2] for r in want}) > 1
    assert got(spark, texts, ids, 4, 80, 100) == want


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e f"] * 3 + ["g h i j", "g h i j", None, None, "k l m n", "a b c d e f"]
    ids = [7, None, 7, None, None, None, 3, 3, 5]
    assert got(spark, texts, ids, 4, 80, 100) == brute(texts, ids, 4, 80, 100)


def test_empty_table(spark):
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_signatures():
    rnd = random.Random(4)
    sets = [shingle_hashes(" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n)), 4) for n in (1, 5, 40, 3_000)]
    for own, value in zip(sets, M.signatures(sets), strict=True):
        bins = {}
        for h in own.tolist():
            bins.setdefault(h * M.BINS >> 64, h)
        for i in range(M.BINS):
            at, attempt = i, 0
            while at not in bins:
                attempt += 1
                at = int(M._probe(np.array([i]), attempt)[0])
            assert int(value[i]) == bins[at]
    a = family(rnd, 400, 2, 0)[0].split(" ")
    near = a[:380] + [f"z{i}" for i in range(20)]
    x, y = (shingle_hashes(" ".join(w), 4) for w in (a, near))
    agree = (M.signatures([x]) == M.signatures([y])).mean()
    assert abs(agree - len(np.intersect1d(x, y)) / len(np.union1d(x, y))) < 0.1
    assert (M.bucket_keys(M.signatures([x])) == M.bucket_keys(M.signatures([y]))).sum() > 5


def test_sql(spark):
    assert difference(spark, M.op11_minhash_dedup, M.OP11_SQL, "/root/testdata/sf0.001") is None
