"""Each operator against a brute-force version or its library on small rows with nulls, ties, repeats and clashes."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import pyarrow as pa

from spanframe.llm import ann, byte_bpe, cdc, fingerprint, html_extract, jaccard, langid, lm, packing, shingles, substring_dedup, token_counts
from spanframe.llm.components import components

LONG = " ".join(f"word{i % 97}x{i}" for i in range(6_000))
TEXTS = ["Hello,  wörld it's\n\n 12½ ", None, "", "   ", "a", "漢字🙂 x́ İß <|endoftext|> end", "tab\tand\x1c\x85 odd", LONG, "Hello,  wörld it's\n\n 12½ "]


def documents(spark, texts, ids=None):
    """Rows with columns whose names clash with what the operators add."""
    rows = [(i, t, 1, "x", 2, 3.0) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, digest string, length int, score double")


def test_byte_bpe_is_the_rank_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(3)
    alphabet = list(" \n\t\r\xa0abcABC123'sé漢🙂½<|>") + ["'ll", " the", "  "]
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(200)]
    for r in byte_bpe.round_trip_digests(documents(spark, texts), path).collect():
        text = texts[r["doc_id"]] or ""
        ids = np.asarray(own.encode_ordinary(text), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(documents(spark, texts), path), path)
    assert {r["doc_id"]: bytes(r["text"]).decode() for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(public_tokenizers.path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    for r in token_counts.count_tokens(documents(spark, TEXTS), name).collect():
        text = TEXTS[r["doc_id"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), count(text))


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = TEXTS + [f"short text {i} " * (i % 50) for i in range(120)]
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    rows = packing.pack(documents(spark, texts), "byte_bpe_50k.json", 512, keep_ids=True).collect()
    places, pieces = {}, {}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        data = np.asarray(own, "<u4").tobytes()
        assert bytes(r["ids"]) == data and r["ids_crc32"] == zlib.crc32(data)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for i, own in pieces.items():
        assert [(s, n) for _, s, n in sorted(own)] == packing.cut(len(ids[i]), 512)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(map(len, ids.values()))
    assert sorted(pieces) == list(range(len(texts))) and len(places) <= 1.03 * -(-total // 512) + 1
    assert packing.pack(documents(spark, []), "byte_bpe_50k.json").count() == 0


def page(n, body, extra=""):
    return f"<html><head><title>t{n}</title><script>var a='</p>';</script></head><body><nav><ul><li><a>Menu {n}</a></li></ul></nav>{extra}<div class='ad'>Buy {n}</div>{body}<footer>&copy; {n}</footer></body></html>"


def test_html_text(spark):
    article = "<article><h1>T&amp;{0}</h1><p>one  <b>two</b><br>three{0}<p>four{0}</p><ul><li>item{0}</ul></article>"
    rows = [(i, "http://a.org/x", page(i, article.format(i))) for i in range(8)]
    plain = "<div class='body'><p>Same words on every page</p><p>Own words {0} of this page, which say something of their own</p></div>"
    rows += [(100 + i, "http://b.org/x", page(i, plain.format(i))) for i in range(8)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c.org", "<p>a<p>b &lt;c&gt;"), (203, "http://d.org", "<div" * 3 + "<div>" * 5_000 + "deep"), (8, "http://a.org/x", page(8, article.format(8))), (8, "http://a.org/x", page(8, article.format(8)))]
    rows += [(300 + i, "http://long.org", page(i, f"<article><p>{LONG} {i}</p></article>")) for i in range(2)]
    # Small hosts of one shape know each other's template.
    small = "<body><div><p>One notice of the shop system</p></div><section><p>Text of page {0} is here</p><p>and goes on with {0}</p></section></body>"
    rows += [(400 + i, f"http://small{i}.org", small.format(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("slots", F.lit(1))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert html_extract.extract(df).where("page_id = 8").count() == 2 and html_extract.extract(df.limit(0)).count() == 0
    for i in range(9):
        assert got[i]["text"] == f"T&{i}\n\none two three{i}\n\nfour{i}\n\nitem{i}"
    for i in range(8):
        assert got[100 + i]["text"] == f"Own words {i} of this page, which say something of their own"
    assert (got[200]["text"], got[200]["n_chars"], got[201]["text"]) == ("", 0, "")
    assert got[202]["text"] == "a\n\nb <c>" and got[203]["text"].endswith("deep")
    for i in range(2):
        assert got[300 + i]["text"] == f"{LONG} {i}"
    for i in range(4):
        assert got[400 + i]["text"] == f"Text of page {i} is here\n\nand goes on with {i}"


@pytest.mark.parametrize("named", [True, False])
def test_html_slots_decide_without_names(spark, named):
    """Menus, adverts and footers vary from page to page; without element names the slots still tell them apart."""
    rnd = random.Random(7)
    words = lambda n: " ".join("".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        paragraphs = [words(4), *(words(rnd.randint(20, 60)) for _ in range(rnd.randint(2, 5)))]
        menu = "".join(f"<li><a href='/{k}'>{words(1)}</a></li>" for k in range(rnd.randint(3, 6)))
        body = f"<h1>{paragraphs[0]}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:])
        parts = ("nav", "article", "footer") if named else ("div", "div", "div")
        html = f"<body class='has-sidebar'><{parts[0]}><ul>{menu}</ul></{parts[0]}><div>{words(3)}</div><{parts[1]}>{body}</{parts[1]}><{parts[2]}>{words(5)}</{parts[2]}></body>"
        rows.append((i, f"http://x.org/{i}", html))
        want[i] = "\n\n".join(paragraphs)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_odd_pages_take_linear_time():
    import json
    import time

    began = time.time()
    assert html_extract.Wrapper(None).text("<p>text</p>" + "<a " * 20_000).startswith("text")
    html = "<body>" + "<h2>a</h2><p>b</p>" * 3_000 + "</body>"
    html_extract.Wrapper(json.dumps(html_extract.skeleton([html_extract.parse(html)]))).text(html)
    assert time.time() - began < 20


def word_sets(text, k):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_copies(rnd, groups, copies, words, edits):
    vocabulary = [f"w{i}" for i in range(5_000)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(base)
            out.append(" ".join(own))
    return out


def brute_components(texts, ids, k, num, den):
    sets = [word_sets(t, k) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, own in enumerate(ids):
        least[top(i)] = min(least.get(top(i), own), own)
    return sorted((own, len(sets[i]), least[top(i)]) for i, own in enumerate(ids))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join_is_exact(spark, k, num):
    rnd = random.Random(k)
    texts = near_copies(rnd, 6, 12, 90, 6) + near_copies(rnd, 3, 5, 4, 1) + [t or "" for t in TEXTS] + [None, "A B", "a b", "b a", "one", "ONE "]
    ids = [3 * i + 1 for i in range(len(texts))]
    got = jaccard.similar_components(documents(spark, texts, ids), k, num, 100)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.drop("is_first").collect()) == brute_components(texts, ids, k, num, 100)
    assert got.where("is_first").select("component_id").distinct().count() == got.where("is_first").count()


def test_jaccard_join_of_repeated_rows_and_none(spark):
    texts = ["x y z w v", "x y z w v", None, "q r s t"]
    rows = jaccard.similar_components(documents(spark, texts, [5, 5, None, None]), 3, 90, 100).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (0, 0), (5, 5), (5, 5)]
    assert sum(r["is_first"] for r in rows if r["doc_id"] == 5) == 1
    assert jaccard.similar_components(documents(spark, []), 3, 90, 100).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 90), (90, 95)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}


def test_components_of_stars_are_written_once(spark, monkeypatch):
    """Edges doubled, turned round and to themselves; twelve large stars and a triangle."""
    from spanframe.llm import components as module

    edges = [(i % 12, i) for i in range(12, 400)] + [(i, i % 12) for i in range(12, 100)] + [(5, 5), (900, 901), (901, 902), (902, 900)] + [(777, 777)]
    writes, stored = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name="t": writes.append(name) or stored(df, name))
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(got) == [(i, i % 12) for i in range(400)] + [(900, 900), (901, 900), (902, 900)]
    assert len(writes) == 1


def test_large_groups_merge_though_the_first_links_with_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(10):  # meet the group, but share too little with it
        own = [w if rnd.random() > 0.07 else f"o{rnd.randint(0, 10**6)}" for w in base]
        texts.append(" ".join(own))
    for i in range(60):
        own = list(base)
        own[3 * i + 5] = f"x{i}"
        texts.append(" ".join(own))
    pairs, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda p, *rest: pairs.append(p.count()) or verified(p, *rest))
    ids = list(range(len(texts)))
    got = jaccard.similar_components(documents(spark, texts, ids).coalesce(1), 5, 80, 100)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.drop("is_first").collect()) == brute_components(texts, ids, 5, 80, 100)
    # All pairs of the sixty are 1,770.
    assert pairs[-1] < 100 and sum(pairs) < 600


def test_shingle_hashes_stand_for_shingles():
    rnd = random.Random(8)
    texts = near_copies(rnd, 4, 6, 30, 8) + ["", " ", "a", "A b", "é É"]
    for k in (1, 3, 5):
        for a in texts:
            for b in texts:
                both = len(np.intersect1d(shingles.shingle_hashes(a, k), shingles.shingle_hashes(b, k)))
                assert both == len(word_sets(a, k) & word_sets(b, k))


def test_substring_dedup_cuts_planted_passages(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("aeiourstlnd") for _ in range(rnd.randint(2, 9))) for _ in range(3_000)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passages = [prose(rnd.randint(55, 120)) for _ in range(12)]
    texts, planted = [], {}
    for i in range(80):
        if i % 4 == 1:
            p = passages[rnd.randrange(len(passages))]
            planted[i] = p
            texts.append(f"{prose(rnd.randint(0, 60))} {p} {prose(rnd.randint(1, 90))}")
        else:
            texts.append(prose(rnd.randint(0, 200)))
    texts += [None, "", "   ", " ".join(["same"] * 200)]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        expected = i in planted and planted[i] in seen
        assert bool(got[i]["spans"]) == expected, i
        if i in planted:
            seen.add(planted[i])
        if expected:
            removed = "".join(t[s["start"] : s["end"]] for s in got[i]["spans"])
            assert len(removed) > 0.5 * len(planted[i]) and removed.strip() in planted[i] and planted[i] not in got[i]["text"]
        else:
            assert got[i]["text"] == t
    assert got[0]["digest"] == "x" and substring_dedup.remove_repeats(documents(spark, [])).count() == 0
    clash = documents(spark, texts).withColumnsRenamed({"digest": "key", "length": "parts", "n_tokens": "slot", "score": "c0"})
    again = {r["doc_id"]: r for r in substring_dedup.remove_repeats(clash).collect()}
    assert all(again[i]["text"] == got[i]["text"] and again[i]["key"] == "x" and again[i]["slot"] == 1 and again[i]["c0"] == 3.0 for i in got)
    with pytest.raises(ValueError, match="spans"):
        substring_dedup.remove_repeats(clash.withColumnRenamed("key", "spans"))


def test_substring_dedup_cuts_every_repeat_to_the_word(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("aeiourstlnd") for _ in range(rnd.randint(4, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(25 + i % 30) for i in range(150)] + [" ".join([word()] * 60), (prose(6) + "\n") * 12]
    texts = [f"{prose(9)} {p} {prose(9)}" for p in passages]
    ends = [(prose(12), prose(12)) for _ in passages]
    texts += [f"{a} {p} {b}" for (a, b), p in zip(ends, passages, strict=True)]
    texts += [f"{prose(9)} {' '.join(p.split()[:24])} {prose(9)}" for p in passages[:20]]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    n = len(passages)
    for i, t in enumerate(texts):
        assert got[i] == (" ".join(ends[i - n]) if n <= i < 2 * n else t), i


def test_substring_dedup_cuts_text_without_spaces(spark):
    rnd = random.Random(12)
    han = lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n))
    thai = lambda n: "".join(chr(rnd.randrange(0x0E01, 0x0E2F)) + " " * (rnd.random() < 0.1) for _ in range(n)).strip()
    plain = lambda n: "".join(rnd.choice("abcdefghij0123456789") for _ in range(n))
    prose = lambda n: " ".join(plain(rnd.randint(2, 9)) for _ in range(n))
    passages = [han(120), thai(150), plain(600), han(60), f"{han(30)} {prose(20)} {han(10)}"]
    around = [(han(40), han(40)), (thai(30) + " ", " " + thai(30)), (prose(300) + " ", " " + prose(300)), (prose(80) + " ", " " + prose(80)), (prose(9) + " ", " " + han(8))]
    texts = [f"{prose(5)} {p} {prose(5)}" for p in passages] + [f"{a}{p}{b}" for p, (a, b) in zip(passages, around, strict=True)]
    short = han(45)
    texts += [han(20) + short, short + han(20)]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        a, b = around[i - 5] if 5 <= i < 10 else (t, "")
        assert got[i] == (a + b.lstrip() if 5 <= i < 10 else t), i


def test_chunks_resist_shifts():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 9))) for _ in range(2_000))
    a, b = fingerprint.chunk_weights(text), fingerprint.chunk_weights("Inserted. " + text)
    assert fingerprint.containment(a, b) > 0.95
    data = "é漢字🙂 text ".encode() * 50
    ends = cdc.boundaries(data, 12, 32, 128, 6, 3)
    assert ends[-1] == len(data) and all(data[:e].decode() is not None for e in ends)
    h, raw = cdc.gear_hash(np.frombuffer(data, np.uint8)), np.frombuffer(data, np.uint8)
    for i in (0, 5, 15, 16, 99):
        assert h[i] == sum(int(cdc.GEAR[raw[i - k]]) << k for k in range(16) if i >= k) & 0xFFFF


def test_fingerprints_follow_the_next_id(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rnd = random.Random(6)
    texts = TEXTS + [" ".join(str(rnd.random()) for _ in range(rnd.randint(0, 40))) for _ in range(50)]
    ids = rnd.sample(range(1_000), len(texts))
    documents(spark, texts, ids).repartition(5).createOrReplaceTempView("d")
    made = lambda own, after: {"edited": __import__("pyarrow").array([fingerprint.edited(t, n) for t, n in zip(own, after, strict=True)])}
    got = {r["doc_id"]: r["edited"] for r in fingerprint.with_next(spark.table("d"), "edited string", made).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda x: x[0])
    want = {i: fingerprint.edited(t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)}
    assert got == want
    weights = fingerprint.chunk_weights(LONG)
    assert fingerprint.from_string(fingerprint.to_string(weights)) == weights
    assert (fingerprint.containment({}, {}), fingerprint.containment(weights, {})) == (1.0, 0.0)


def plain_chunks(data):
    """Chunks byte by byte, each hash anew."""
    ends, at = [], 0
    for e in range(1, len(data) + 1):
        h = sum(int(cdc.GEAR[data[e - 1 - k]]) << k for k in range(16) if e - 1 - k >= 0) & 0xFFFF
        size = e - at
        whole = e == len(data) or data[e] & 0xC0 != 0x80
        bits = fingerprint.STRICT_BITS if size < fingerprint.NORMAL else fingerprint.LOOSE_BITS
        if e < len(data) and whole and size >= fingerprint.LEAST and len(data) - at > fingerprint.LEAST and h >> (16 - bits) == 0:
            ends.append(e)
            at = e
        elif size == fingerprint.MOST and e < len(data):
            back = e
            while data[back] & 0xC0 == 0x80:
                back -= 1
            ends.append(back)
            at = back
    return [*ends, len(data)]


def test_chunks_against_a_plain_loop():
    rnd = random.Random(13)
    for n in (0, 5, 13, 40, 200, 900):
        text = "".join(rnd.choice("abcdefgh é漢 ") for _ in range(n))
        data = text.encode()
        ends = plain_chunks(data) if data else []
        assert cdc.boundaries(data, fingerprint.LEAST, fingerprint.NORMAL, fingerprint.MOST, fingerprint.STRICT_BITS, fingerprint.LOOSE_BITS) == ends
        pieces = {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}
        assert sorted(fingerprint.chunk_weights(text).values()) == sorted(map(len, pieces))


def test_ann_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3_000, 32))
    x[100:140] = x[99]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9_000, None), (9_050, [0.0] * 32), (9_100, [float("nan")] * 32), (9_150, [None, *[1.0] * 31]), (9_200, [float("inf")] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index, books = ann.build_index(df)
    got = {}
    for r in ann.search(index, books, index.where("id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 3_000, 50))
    for q, found in got.items():
        score = u @ u[q]
        score[q] = -9
        best = np.lexsort((np.arange(3_000), -np.round(score, 12)))[:5]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in sorted(got[100])] == [99, 101, 102, 103, 104]
    odd = df.unionAll(spark.createDataFrame([(9_300, [1.0] * 7), (None, [1.0] * 32), (99, x[99].tolist())], df.schema))
    index, books = ann.build_index(odd)
    assert index.count() == 3_001 and ann.search(index, books, index.where("id = 100"), 5).orderBy("rank").first()["vec_id"] == 99
    none, books = ann.build_index(df.limit(0))
    assert ann.search(none, books, none, 5).count() == 0


def test_crf_marginals_are_forward_backward():
    rng = np.random.default_rng(3)
    labels = ["a", "b", "c"]
    crf = langid.Crf(labels, None, rng.standard_normal((3, 3)), rng.standard_normal(3), {})
    n = 700
    scores = rng.standard_normal((n, 3))
    first = rng.random(n) < 0.02
    first[0] = True
    got = crf.marginals(scores, first)
    starts = [*np.flatnonzero(first), n]
    for s, e in zip(starts, starts[1:], strict=False):
        alpha = [np.exp(crf.start + scores[s])]
        for t in range(s + 1, e):
            a = (alpha[-1] @ np.exp(crf.transitions)) * np.exp(scores[t])
            alpha.append(a / a.sum())
        beta = [np.ones(3)]
        for t in range(e - 1, s, -1):
            b = np.exp(crf.transitions) @ (np.exp(scores[t]) * beta[-1])
            beta.append(b / b.sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[s:e], want / want.sum(1, keepdims=True))


def test_language_id(spark):
    rnd = random.Random(4)
    words = {"xx": ["kala", "kuta", "mala", "naka", "taka"], "yy": ["strom", "brick", "ghost", "frond", "clump"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(["", "s", ","]) for _ in range(n))
    rows = [(i, text(lang, rnd.randint(3, 60)), lang) for i in range(60) for lang in ["xx" if i % 2 else "yy"]]
    odd = [(1_000, None, "xx"), (1_001, "123 ?! ", "yy"), (1_002, "", None), (1_003, text("xx", 40) + " " + text("yy", 9), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    crf = langid.fit(langid.training_sample(docs.where("doc_id % 3 <> 1")))
    got = {r["doc_id"]: r for r in langid.identify(docs, crf, keep=["lang"]).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert [got[i]["lang_pred"] for i, _, _ in odd] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    with pytest.raises(ValueError):
        langid.identify(documents(spark, ["a"]), crf, keep=["score"])
    assert langid.identify(docs.limit(0), crf).count() == 0
    empty = langid.fit(langid.training_sample(docs.limit(0)))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_language_features_depend_on_the_word_alone():
    texts = ["Kala, \u00c9t\u00e9! kala 12 \u6f22\u5b57 x", "", "kala-kala K\u00e4se", "x"]
    words = langid.Words(texts)
    want = [(i, "".join(filter(str.isalpha, w))) for i, t in enumerate(texts) for w in t.lower().split()]
    want = [(i, w) for i, w in want if w]
    assert words.text.tolist() == [i for i, _ in want]
    kinds = {}
    for (_, w), k in zip(want, words.kind.tolist(), strict=True):
        assert kinds.setdefault(w, k) == k
    assert len(set(kinds.values())) == len(kinds)
    lexicon = {int(words.hash[kinds["kala"]]): 1}
    numbers, base = langid.features(words, lexicon)
    ends = [*base.tolist(), len(numbers)]
    for w, k in kinds.items():
        alone = langid.Words([w])
        assert sorted(langid.features(alone, lexicon)[0].tolist()) == sorted(numbers[ends[k] : ends[k + 1]].tolist())
        n = len(w)
        assert ends[k + 1] - ends[k] == 2 * n + 1 + 2 * min(3, max(1, n - 1)) + 2 * (w == "kala")


def test_lm_gradient_and_distribution():
    rng = np.random.default_rng(0)
    some = rng.integers(0, 300, (30, lm.WINDOW + lm.STRIDE)).astype("<u2")
    some[:9, : lm.WINDOW - lm.STRIDE] = lm._PAD
    some[7, -3:] = lm._PAD
    count = rng.integers(0, 50, 400)
    model = lm.initial(some, count, 399)
    model = model.with_weights({k: v.astype(np.float64) for k, v in model.p.items()})
    inputs, targets = some[:, : lm.WINDOW], some[:, lm.WINDOW :]
    x, y = np.where(inputs == lm._PAD, lm.LEAVES, model.leaf_of[np.minimum(inputs, 399)]), model.class_of[np.minimum(targets, 399)]
    _, g = lm.gradient(model, x, y, targets != lm._PAD)
    for k, v in model.p.items():
        i = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        kept, h = v[i], 1e-4
        v[i] = kept + h
        up = lm.gradient(model, x, y, targets != lm._PAD)[0]
        v[i] = kept - h
        down = lm.gradient(model, x, y, targets != lm._PAD)[0]
        v[i] = kept
        assert g[k][i] == pytest.approx((up - down) / 2 / h, rel=1e-3, abs=1e-6)
    follow = rng.integers(0, 3, (lm.GROUPS + 1, lm.LEAVES)) * (rng.random(lm.LEAVES) < 0.1)
    model.follow(follow)
    # After any text the chances of all next subwords sum to one.
    for text in ([], [3], rng.integers(0, 399, 40).tolist()):
        ends = [np.array([*text, w]) for w in range(400)]
        logs = model.log_tokens(np.concatenate(ends), np.array([len(e) for e in ends]))
        assert (10.0 ** logs[np.cumsum([len(e) for e in ends]) - 1]).sum() == pytest.approx(1.0, rel=1e-4)


def test_lm_scores_as_token_by_token():
    rng = np.random.default_rng(2)
    some = rng.integers(0, 300, (200, lm.WINDOW + lm.STRIDE)).astype("<u2")
    model = lm.train(lm.initial(some, np.bincount(some.ravel(), minlength=400), 399), some, 20)
    model.follow(rng.integers(0, 3, (lm.GROUPS + 1, lm.LEAVES)))
    p = {k: v.astype(float) for k, v in model.p.items()}
    texts = [np.append(rng.integers(0, 399, n), 399) for n in (0, 1, lm.STRIDE - 1, lm.STRIDE, 77)]
    got = model.log_tokens(np.concatenate(texts), np.array([len(t) for t in texts]))
    want = []
    for t in texts:
        source = [399, *t[:-1].tolist()]
        for i, w in enumerate(t.tolist()):
            first = max(0, i // lm.STRIDE * lm.STRIDE + lm.STRIDE - lm.WINDOW)
            e = p["E"][[model.leaf_of[s] for s in source[first : i + 1]]]
            q = e[-1] @ p["Q"]
            s = np.exp([q @ (k @ p["K"]) + p["B"][len(e) - 1 - j] for j, k in enumerate(e)])
            h = e[-1] + (s / s.sum()) @ e @ p["V"] @ p["O"]
            z = h + np.maximum(h @ p["M"] + p["m"], 0) @ p["N"]
            o = z @ p["C"] + p["c"]
            own = o[model.class_of[w]] - np.log(np.exp(o).sum())
            want.append(own / np.log(10) + model.after.reshape(-1, lm.LEAVES)[model.group_of[source[i]], model.leaf_of[w]] + model.share[w])
    assert np.allclose(got, want, atol=2e-4)


def test_lm_windows_score_each_token_once():
    lengths = np.array([1, lm.STRIDE, lm.STRIDE + 1, 200])
    place, scored = lm.windows(lengths)
    assert sorted(scored[scored >= 0].tolist()) == list(range(lengths.sum()))
    text = np.repeat(np.arange(4), lengths)
    for row in place:
        assert len(set(text[row[row >= 0]])) == 1 and (np.diff(row[row >= 0]) == 1).all()


def lm_words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return [*(text or "").encode().translate(low).split(), None]


def test_lm_base_counts(spark, monkeypatch):
    import collections
    import math

    monkeypatch.setattr(lm, "STEPS", 5)
    texts = ["The cat\tsat", "the dog", None, "", "THE end the", "rare é É", "the cat", LONG]
    rows = lm.score_texts(documents(spark, [*texts, "the cat"], [*range(8), 0]), "byte_bpe_50k.tiktoken", F.col("doc_id") != 6).collect()
    words = [lm_words(t) for t in texts]
    c = collections.Counter(w for i in (0, 0, 1, 2, 3, 4, 5, 7) for w in words[i])
    c.update(words[6])
    c.subtract(words[0])
    n, v = sum(c.values()), sum(x > 0 for x in c.values())
    assert len(rows) == 9
    for r in rows:
        own = words[r["doc_id"]] if r["doc_id"] or r["n_tokens"] == 4 else words[6]
        assert (r["held_out"], r["train_tokens"]) == (r["doc_id"] == 6, n)
        if r["doc_id"]:
            assert (r["n_tokens"], r["n_known"]) == (len(own), sum(c[w] > 0 for w in own))
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0
    assert lm.score_texts(documents(spark, []), "byte_bpe_50k.tiktoken", F.col("doc_id") != 6).count() == 0
    none = lm.score_texts(documents(spark, texts[:3]), "byte_bpe_50k.tiktoken", F.lit(False)).collect()
    assert {(r["held_out"], r["n_known"], r["train_tokens"]) for r in none} == {(True, 0, 0)} and all(np.isfinite(r["score"]) for r in none)


def test_lm_whole_words_and_memory_leave_a_document_out(monkeypatch):
    """Scores against a plain count over the other documents, word by word; buckets and blocks without Spark."""
    import math
    from collections import Counter
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(lm, "MEMORY", 1)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 30))) for _ in range(25)]
    texts += [texts[3], None]
    ids = list(range(len(texts)))
    model = SimpleNamespace(log_tokens=lambda ids, lengths: np.full(len(ids), -1.0), words=sum(len(lm_words(t)) for i, t in enumerate(texts) if i % 5 != 2))
    batches = [pa.RecordBatch.from_pydict({"id": ids[k::3], "text": pa.array(texts[k::3], pa.string()), "train": [i % 5 != 2 for i in ids[k::3]]}) for k in range(3)]
    asked = pa.Table.from_batches(list(lm._parts(2)(iter(batches))))

    def grouped(t, key, fn):
        return pa.concat_tables([fn(t.filter(pa.array([x == k for x in t[key].to_pylist()]))) for k in sorted(set(t[key].to_pylist()))])

    answers = grouped(asked, "bucket", lm._counted)
    out = grouped(answers, "block", lm._scored(public_tokenizers.path("byte_bpe_50k.tiktoken"), SimpleNamespace(value=model))).to_pydict()
    assert sorted(out["id"]) == ids
    got = dict(zip(out["id"], out["score"], strict=True))
    words = [lm_words(t) for t in texts]
    for i, own in enumerate(words):
        others = [w for j, w in enumerate(words) if j % 5 != 2 and j != i]
        count, n = Counter(w for o in others for w in o), sum(map(len, others))
        after = {}
        for o in others:
            for k in range(lm.CONTEXT, len(o)):
                after.setdefault(tuple(o[k - lm.CONTEXT : k]), Counter())[o[k]] += 1
        want = 0.0
        for k, w in enumerate(own):
            # Every word here is one subword.
            p = (1 - lm.MIXED) * 0.1 + lm.MIXED * count[w] / n
            seen = after.get(tuple(own[k - lm.CONTEXT : k])) if k >= lm.CONTEXT else None
            if seen:
                p = (max(seen[w] - lm.DISCOUNT, 0) + lm.DISCOUNT * len(seen) * p) / sum(seen.values())
            want += math.log10(p)
        assert got[i] == pytest.approx(want, abs=1e-9), i


def test_lm_rounds_learn_from_all_shards(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aeinrst") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(vocabulary[(i + k) % 40] for k in range(150)) for i in range(60)]
    monkeypatch.setattr(lm, "STEPS", 10)
    monkeypatch.setattr(lm, "EVERY", 2)
    monkeypatch.setattr(lm, "SHARD_CHARS", 8_000)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, texts).select(F.col("doc_id").alias("id"), "text")
    words = lm.Words([texts[0].encode()])
    ids, size = lm.Subwords(path)(words)
    score = lambda: lm.fit(docs, path).log_tokens(ids, np.array([len(ids)])).sum()
    after = score()
    monkeypatch.setattr(lm, "rounds", lambda model, *_: model)
    assert score() < after - 1


def test_lm_counts_and_windows_of_whole_texts(spark, monkeypatch):
    """Every token of every training text is a target once, and every pair of neighbours a context, whatever the shards."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 1, 12, 13, 400]))) for _ in range(50)] + [None]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    words = lm.Words([(t or "").encode() for t in texts])
    ids, _ = lm.Subwords(path)(words)
    end = lm.Subwords(path).end
    count, seen = np.bincount(ids, minlength=end + 1), {}
    rows = pa.table({"id": pa.array([*range(50), None], pa.int64()), "text": pa.array(texts, pa.string())}).to_batches()
    for shards in (1, 3):
        out = pa.Table.from_batches(list(lm._prepared(path, shards)(iter(rows))))
        told = {s: n for s, n in zip(out["subword"].to_pylist(), out["n"].to_pylist(), strict=True) if s is not None}
        assert told == {-1: len(words.hash)} | {i: int(count[i]) for i in np.flatnonzero(count)}
        own = out.filter(pa.array([s is not None for s in out["shard"].to_pylist()])).select(["data", "shard"])
        parts = [own.filter(pa.array([x == s for x in own["shard"].to_pylist()])).to_batches() for s in range(shards)]
        some = np.concatenate([lm._gathered(p, end) for p in parts])
        targets = some[:, lm.WINDOW :]
        assert (np.bincount(targets[targets != lm._PAD], minlength=end + 1) == count).all()
        pairs = np.concatenate([last.astype(np.int64) << 16 | own_ids for p in parts for own_ids, last in lm._neighbours(p, end)])
        seen[shards] = np.sort(pairs)
    assert len(seen[1]) == len(ids) and (seen[1] == seen[3]).all()


def test_jaccard_postings_are_shuffled_once(spark, monkeypatch):
    plans, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or verified(pairs, *rest))
    rnd = random.Random(2)
    texts = near_copies(rnd, 3, 4, 60, 3)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert jaccard.similar_components(documents(spark, texts), 3, 90, 100).count() == len(texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # The two sides of the join on tokens have the same exchange, which Spark then runs once.
    shuffles = [x.split("Exchange", 1)[1].split("plan_id")[0] for x in plans[-1].split("\n") if "hashpartitioning(token#" in x]
    assert len(shuffles) <= 2 and plans[-1].count("MapInArrow") == len(shuffles)
