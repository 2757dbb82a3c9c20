"""Alignment of two tokenizers against the libraries and byte offsets, with counts taken pair by pair."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter

import public_tokenizers
from test_operators import TEXTS, documents

from spanframe.llm import token_alignment as T

RANKS, MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    from spanframe.llm.byte_bpe import byte_characters

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    byte_of = {c: i for i, c in enumerate(byte_characters())}

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        own = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids]
        other = b.encode(text)
        theirs = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in other]
        return ids, own, other, theirs

    return tokens


def brute(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha256, groups) of texts."""
    tokens = libraries()
    grouped = []
    for t in texts:
        groups = []
        if t:
            a, own, b, theirs = tokens(t)
            if b"".join(own) == b"".join(theirs) == (" " + t).encode():
                ends = []
                for ids, parts in ((a, own), (b, theirs)):
                    at, out = 0, []
                    for i, p in zip(ids, parts, strict=True):
                        at += len(p)
                        out.append((i, at))
                    ends.append(out)
                common = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
                groups = [([], []) for _ in common]
                for k, side in enumerate(ends):
                    for i, e in side:
                        groups[bisect_left(common, e)][k].append(i)
        grouped.append(groups)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in grouped]
    count = Counter(p for own in links for p in own)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for g, own in zip(grouped, links, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else "", text))
    return out


def check(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    docs = documents(spark, texts, ids).repartition(3)
    want = brute(texts)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = sorted((tuple(r[c] for c in columns) for r in T.align_counted(docs, RANKS, MODEL).collect()), key=repr)
    assert got == sorted(((i, *w[:7]) for i, w in zip(ids, want, strict=True)), key=repr)
    plain = sorted((tuple(r) for r in T.align(docs, RANKS, MODEL).collect()), key=repr)
    assert plain == sorted(((i, *w[:4], w[7]) for i, w in zip(ids, want, strict=True)), key=repr)


def test_alignment(spark):
    rnd = random.Random(5)
    alphabet = list(" \n\t\xa0abcABC123'sé漢🙂½<|>\x1c") + ["'ll", " the", "  ", "ization", " naïve"]
    odd = ["a▁b", "x ▁", " lead", "trail ", "<s> </s> <unk> <0x41>", "<|endoftext|> end", "́ a ́b", "a  b", "e\x85 f", "ﬁ ½ é 　x", "\0 nul"]
    check(spark, TEXTS + odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(150)])


def test_repeats_and_null_ids(spark):
    check(spark, ["one text here", "one text here", None, "", "one other"], [3, 3, None, None, 3])


def test_long_texts_and_long_words(spark):
    rnd = random.Random(6)
    word = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    check(spark, [word, word + " " + word[:50], " ".join(f"w{i % 800}" for i in range(60_000)), "a" * 5_000, "漢" * 3_000])


def test_empty_table(spark):
    assert T.align_counted(documents(spark, []), RANKS, MODEL).count() == 0 and T.align(documents(spark, []), RANKS, MODEL).count() == 0


def test_steps():
    by = T.Transducer([b"a", b"ab", b"bc"], [b"a", b"b", b"c", b"abc", b"x"])
    assert by.groups([1, 0], [0, 1, 0]) == [([1], [0, 1]), ([0], [0])]
    assert by.groups([0, 2], [3]) == [([0, 2], [3])]
    assert by.groups([0, 2], [0, 1]) is None and by.groups([0], [4]) is None and by.groups([], []) == [] and by.groups([], [0]) is None
    ahead = by.state(0, b"ab")
    assert ahead > 0 and by.left[by.step(ahead, 0)] == b"b" and by.step(ahead, 3) == by.state(1, b"c") < 0 and by.step(ahead, 4) is None
    assert T.links([([1, 1, 2], [5, 6, 5])]) == {(1, 5): 4, (1, 6): 2, (2, 5): 2, (2, 6): 1}


def test_tokens_alike_are_grouped_without_the_transducer(monkeypatch):
    own, asked, groups = T.Aligner(T.vocabulary(RANKS), T.vocabulary(MODEL)), [], T.Transducer.groups
    monkeypatch.setattr(T.Transducer, "groups", lambda self, a, b: asked.append((a, b)) or groups(self, a, b))
    own.learn({"the", "of", "and"})
    assert not asked and sorted(own.place) == ["and", "of", "the"]
    assert list(own.columns[2]) == list(own.columns[3]) == [1, 1, 1] and all(t.count("|") == 1 for t in own.text)
