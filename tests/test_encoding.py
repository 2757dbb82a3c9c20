"""Sub-words and their offsets against the tokenizer library on whole texts."""

import random
from functools import lru_cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanframe.operators import alignment as A
from spanframe.operators import encoding as N
from spanframe.operators.fixtures import gold_spans

NAME = "byte_bpe_50k.json"


LIBRARY = Tokenizer.from_file(public_tokenizers.path(NAME))


@lru_cache(maxsize=None)
def whole(text):
    e = LIBRARY.encode(text or "", add_special_tokens=False)
    out = []
    for i, (s, x) in zip(e.ids, e.offsets, strict=True):
        while s < x and text[s].isspace():
            s += 1
        out.append((i, s, x))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    odd = list(" \n\tabé漢🙂'.,12") + ["  ", " the", "ning", " x"]
    out = [None, "", "   ", " lead", "trail ", "Hello,  wörld it's\n\n 12½ ", "e\x1c f\x85g"]
    out += ["".join(rnd.choice(odd) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    out += [" ".join(rnd.choice(["Toshkentda", "naïve", "漢字,", "a", "don't", "\n", "x  y"]) for _ in range(40_000)), "z" * 60_000]
    return out


def test_slices_are_the_text():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice("ab  \n") for _ in range(rnd.randint(0, 60)))
        parts = list(N.slices(text, rnd.randint(1, 9)))
        assert "".join(p for _, p in parts) == text and all(text[at : at + len(p)] == p for at, p in parts)
        assert all(p[0] == " " and not p[1].isspace() and not text[at - 1].isspace() for at, p in parts[1:])


def test_offsets(spark, texts):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, first int, ids string")
    encoded = N.encode(df, public_tokenizers.path(NAME))
    assert {r["doc_id"] for r in encoded.collect()} == set(range(len(texts))) and encoded.where("slice > 3").count() > 0
    got = {}
    for r in N.tokens(encoded).collect():
        got.setdefault(r["doc_id"], []).append((r["pos"], r["token"], r["t_start"], r["t_end"]))
    for i, t in enumerate(texts):
        assert [x[1:] for x in sorted(got.get(i, []))] == whole(t)
        assert [x[0] for x in sorted(got.get(i, []))] == list(range(len(got.get(i, []))))


@pytest.mark.parametrize("most", [1, 7, 30_000])
def test_max_length(spark, texts, most):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = N.encode(df, public_tokenizers.path(NAME), max_length=most)
    tokens = N.tokens(encoded)
    n = {r["doc_id"]: r["count"] for r in tokens.groupBy("doc_id").count().collect()}
    want = {i: whole(t)[:most] for i, t in enumerate(texts)}
    assert n == {i: len(w) for i, w in want.items() if w}
    cut = {r["doc_id"]: r["truncated"] for r in A.truncated(tokens.where("t_end > t_start"), df).collect()}
    for i, w in want.items():
        assert cut[i] == (max((e for _, s, e in w if s < e), default=0) < len((texts[i] or "").rstrip()))


def test_alignment_on_sub_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    off = F.when(F.col("start") % 5 == 0, 1).otherwise(0)
    spans = gold_spans(docs).select("doc_id", (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"), "label")
    got = {r["doc_id"]: (r["n_misaligned"], r["n_lost"]) for r in A.alignment_counts(N.tokens(N.encode(docs, public_tokenizers.path(NAME), max_length=200)).where("t_end > t_start"), spans).collect()}
    want = {}
    for r in spans.collect():
        tokens = [(s, e) for _, s, e in whole(rows[r["doc_id"]])[:200] if s < e]
        met = [(s, e) for s, e in tokens if s < r["end"] and r["start"] < e]
        lost = not met and r["start"] >= max((e for _, e in tokens), default=0)
        wrong = not lost and (not met or met[0][0] != r["start"] or max(e for _, e in met) != r["end"])
        a, b = want.get(r["doc_id"], (0, 0))
        want[r["doc_id"]] = (a + wrong, b + lost)
    assert got == want and sum(b for _, b in want.values()) > 0


def test_corpus_of_parts(spark):
    make = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    rows = N.tokenized_corpus({"a": make("one two", None), "b": make("one two", "three")}, {"a": 4, "b": 2}, public_tokenizers.path(NAME)).collect()
    assert sorted((r["lang_id"], tuple(r["ids"])) for r in rows) == sorted((n, tuple(i for i, _, _ in whole(t))) for n, t in ((4, "one two"), (4, None), (2, "one two"), (2, "three")))
    assert len({(r["lang_id"], r["row"]) for r in rows}) == 4


def test_bounds_by_words_are_those_of_tokens(spark, monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from spanframe.operators import alignment as A
    from spanframe.operators import encoding as N

    path, rnd = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    pieces = ["Anna", "it's", "x,y", "🙂", "é", "12", "...", "<|endoftext|>", "日本", "\u0301a", "b\xa0c", "\x1c"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    texts += ["", " ", "a  b", " a", "b ", "a\n b\tc", None, "a\u3000 b"]
    monkeypatch.setattr(N, "WORDS", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = N.tokens(N.encode(docs, path)).where("t_end > t_start").orderBy("doc_id", "pos").collect()
    got = [np.concatenate(x) for x in zip(*((r + i, s, e) for i in range(0, len(texts), 50) for r, s, e in [N.token_bounds(pa.array(texts[i : i + 50], pa.string()), path)]), strict=True)]
    assert [(r["doc_id"], r["t_start"], r["t_end"]) for r in want] == list(zip(*(x.tolist() for x in got), strict=True))
    # Tags of them against those of rows; spans overlap.
    spans = sorted({(i, a, a + rnd.randint(1, 8), rnd.choice("AB")) for i, t in enumerate(texts) if t for a in rnd.sample(range(len(t) + 3), 2)})
    tokens = spark.createDataFrame([(r["doc_id"], r["pos"], r["t_start"], r["t_end"]) for r in want], "doc_id long, pos long, t_start long, t_end long")
    tags = A.bio_tags(tokens, spark.createDataFrame(spans, "doc_id long, start long, end long, label string")).orderBy("doc_id", "pos").collect()
    own, begins = A.begun(tuple(got), tuple(np.array(c) for c in zip(*spans, strict=True)))
    assert [r["tag"] for r in tags] == ["O" if s < 0 else ("B-" if b else "I-") + spans[s][3] for s, b in zip(own.tolist(), begins.tolist(), strict=True)]


def test_query_of_sub_words_deals_nothing(spark):
    from spanframe.plans.encoding_queries import subword_bio

    assert "Exchange" not in subword_bio(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
