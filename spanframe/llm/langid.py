"""Language of whole texts by a linear-chain conditional random field over words.

Every word with letters gets a score for each language from hashed affix, character n-gram and lexicon
features; learned transition scores tie neighbouring words, so that code-switched texts are labelled
word by word with forward-backward. A text's language has the largest sum of marginals over its words;
its score is that sum's share. Training takes at most DOCS_PER_LABEL whole documents of each label
(those with the smallest hashes), mixed into sequences that switch language, and runs in one task.

Words of a batch are handled together as arrays of code points: each different word's features are
looked up once per batch, and nothing is kept from batch to batch.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanframe.llm.common import batch, crc_mod, map_arrow, table, texts
from spanframe.llm.shingles import _grow, mix

DOCS_PER_LABEL = 200
#: Feature weights, a power of two of them.
BITS = 16
BUCKETS = 1 << BITS
LEXICON, LEXICON_COUNT, LEXICON_SHARE = 20_000, 4, 0.8
EPOCHS, SEQUENCE, AT_ONCE, RATE = 3, 160, 64, 0.1
#: Words of one stretch of forward-backward, and characters handled together.
STRETCH, CHARS = 128, 1_500_000

_U = np.uint64
_AFFIX = 4
_FACTORS = mix(np.arange(1, 33, dtype=_U) << _U(33)) | _U(1)
_TABLES: dict[str, np.ndarray] = {}


def _is(kind: str, code: np.ndarray) -> np.ndarray:
    """str.isalpha or str.isspace of code points."""
    if kind not in _TABLES:
        test = getattr(str, kind)
        _TABLES[kind] = np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)
    return _TABLES[kind][code]


class Words:
    """The words with letters of some texts, lower-cased: `text` of each, `kind` of each (its number among the
    different words), and of each kind its hash and its letters (code, first, length)."""

    def __init__(self, some: list[str]):
        low = [t.lower() for t in some]
        code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = _is("isspace", code)
        start = ~space
        start[1:] &= space[:-1]
        letter = _is("isalpha", code)
        word = np.cumsum(start)[letter] - 1
        self.code = code[letter].astype(_U)
        turn = np.ones(len(word), bool)
        turn[1:] = word[1:] != word[:-1]
        first = np.flatnonzero(turn)
        last = np.append(first[1:], len(word))
        power, inverse = _grow(len(word) + 1)
        total = np.zeros(len(word) + 1, _U)
        np.cumsum(mix(self.code) * power[: len(word)], out=total[1:])
        own = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))
        self.hash, at, self.kind = np.unique(own, return_index=True, return_inverse=True)
        self.first, self.length = first[at], (last - first)[at]
        ends = np.cumsum([len(t) + 1 for t in low])
        self.text = np.searchsorted(ends, np.flatnonzero(start)[word[first]], "right")


def features(words: Words, lexicon: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all kinds of words one after the other, where each kind's begin)."""
    n = words.length
    count = 2 * n + 1 + 2 * np.clip(n - 1, 1, _AFFIX - 1)
    keys = np.fromiter(lexicon, _U, len(lexicon))
    order = np.argsort(keys)
    keys, languages = keys[order], np.fromiter(lexicon.values(), np.int64, len(lexicon))[order]
    near = np.minimum(np.searchsorted(keys, words.hash), max(0, len(keys) - 1))
    known = np.flatnonzero(keys[near] == words.hash) if len(keys) else np.zeros(0, np.int64)
    count[known] += 2
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    if not len(n):
        return out, base

    begin = np.cumsum(n + 2) - (n + 2)
    framed = np.full(int((n + 2).sum()) + _AFFIX, ord("$"), _U)
    framed[begin] = ord("^")
    kind = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(kind)) - np.repeat(np.cumsum(n) - n, n)
    framed[begin[kind] + 1 + within] = words.code[words.first[kind] + within]

    def number(parts, name):
        h = _FACTORS[name].copy()
        for j, x in enumerate(parts):
            h = h + x * _FACTORS[8 + 4 * (name % 6) + j]
        return (mix(h) >> _U(64 - BITS)).astype(np.int64)

    # Pairs from every place but the closing frame, triples from every place but the last two.
    kind = np.repeat(np.arange(len(n)), n + 1)
    within = np.arange(len(kind)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    at = begin[kind] + within
    out[base[kind] + within] = number((framed[at], framed[at + 1]), 0)
    some = within < n[kind]
    kind, within, at = kind[some], within[some], at[some]
    out[base[kind] + n[kind] + 1 + within] = number((framed[at], framed[at + 1], framed[at + 2]), 1)
    to = base + 2 * n + 1
    for k in range(2, _AFFIX + 1):
        some = np.flatnonzero((n >= k) | (k == 2))
        at = begin[some] + 1
        out[to[some]] = number([framed[at + j] for j in range(k)], 2)
        at = begin[some] + np.maximum(0, n[some] + 1 - k)
        out[to[some] + 1] = number([framed[at + j] for j in range(k)], 3)
        to[some] += 2
    out[to[known]] = number((languages[near[known]].astype(_U),), 4)
    out[to[known] + 1] = number((words.hash[known],), 5)
    return out, base


class Crf:
    """labels, weights (BUCKETS, L), transitions (L, L), start (L) and the lexicon (word hash -> label number)."""

    def __init__(self, labels, weights, transitions, start, lexicon):
        self.labels, self.weights, self.transitions, self.start, self.lexicon = labels, weights, transitions, start, lexicon

    def emissions(self, words: Words) -> np.ndarray:
        """Scores (kinds, L)."""
        numbers, base = features(words, self.lexicon)
        if not len(base):
            return np.zeros((0, len(self.labels)))
        return np.stack([np.add.reduceat(column[numbers], base) for column in np.ascontiguousarray(self.weights.T)], 1)

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label marginals (n, L) of words in a row; first marks each text's first word.

        All texts are one chain that starts anew at each mark. It is cut into stretches whose
        transfer matrices are multiplied for all stretches at once; their ends are then linked in
        order and the inside of every stretch is filled in, again for all at once. Exact.
        """
        n, L = scores.shape
        T = min(STRETCH, max(1, n))
        S = -(-n // T)
        e = np.ones((S * T, L))
        e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
        new = np.ones(S * T, bool)
        new[:n] = first
        e = np.ascontiguousarray(e.reshape(S, T, L).transpose(1, 0, 2))
        marks = [np.flatnonzero(x) for x in new.reshape(S, T).T]
        A, start = np.exp(self.transitions - self.transitions.max()), np.exp(self.start - self.start.max())
        P = np.broadcast_to(np.eye(L), (S, L, L)).copy()
        for t in range(T):
            Q = (P.reshape(S * L, L) @ A).reshape(S, L, L)
            Q[marks[t]] = P[marks[t]].sum(2)[:, :, None] * start
            Q *= e[t][:, None, :]
            if t % 4 == 3:
                Q /= Q.max(axis=(1, 2), keepdims=True) + 1e-300
            P = Q
        P /= P.max(axis=(1, 2), keepdims=True) + 1e-300
        enter, leave = np.ones((S, L)), np.ones((S, L))
        for s in range(1, S):
            a = enter[s - 1] @ P[s - 1]
            enter[s] = a / a.sum()
        for s in range(S - 1, 0, -1):
            b = P[s] @ leave[s]
            leave[s - 1] = b / b.sum()
        alpha = np.empty((T, S, L))
        a = enter
        for t in range(T):
            a = a @ A
            a[marks[t]] = start
            a *= e[t]
            a /= a.sum(1, keepdims=True)
            alpha[t] = a
        b = leave
        for t in range(T - 1, -1, -1):
            alpha[t] *= b
            own = e[t] * b
            b = own @ A.T
            b[marks[t]] = (start * own[marks[t]]).sum(1, keepdims=True)
            b /= b.sum(1, keepdims=True)
        out = alpha.transpose(1, 0, 2).reshape(S * T, L)[:n]
        return out / out.sum(1, keepdims=True)


def train(samples: list[tuple[str, str]], seed: int = 3) -> Crf:
    """Fits the field to (text, label) pairs by stochastic gradient ascent on the likelihood."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in samples})
    L = len(labels)
    of = {label: i for i, label in enumerate(labels)}
    words = Words([text for text, _ in samples])
    label_of = np.array([of[label] for _, label in samples], np.int64)
    # How many texts of each label hold a kind.
    held = np.unique(words.kind * max(1, len(samples)) + words.text)
    pairs = (held // max(1, len(samples))) * max(1, L) + (label_of[held % len(samples)] if len(held) else 0)
    counts = np.bincount(pairs, minlength=len(words.hash) * L).reshape(-1, max(1, L)) if L else np.zeros((0, 1), np.int64)
    total = counts.sum(1)
    common = np.lexsort((words.hash, -total))[:LEXICON]
    lexicon = {int(words.hash[k]): int(counts[k].argmax()) for k in common if total[k] >= LEXICON_COUNT and counts[k].max() >= LEXICON_SHARE * total[k]}
    numbers, base = features(words, lexicon)
    ends = np.append(base, len(numbers))
    runs = []
    cuts = np.append(np.flatnonzero(np.diff(words.text, prepend=-1)), len(words.text))
    for s, e in zip(cuts, cuts[1:], strict=False):
        at = s
        while at < e:
            n = int(rng.integers(8, 80))
            runs.append((words.kind[at : min(at + n, e)], label_of[words.text[s]]))
            at += n
    W, A, start = np.zeros((BUCKETS, L)), np.zeros((L, L)), np.zeros(L)
    square = np.full((BUCKETS, L), 1e-3)
    sq_a, sq_s = np.full((L, L), 1e-3), np.full(L, 1e-3)
    for _ in range(EPOCHS if runs else 0):
        order = rng.permutation(len(runs))
        ids = np.concatenate([runs[i][0] for i in order])
        ys = np.concatenate([np.full(len(runs[i][0]), runs[i][1]) for i in order])
        rows = len(ids) // SEQUENCE or 1
        size = min(SEQUENCE, len(ids))
        ids, ys = ids[: rows * size].reshape(rows, size), ys[: rows * size].reshape(rows, size)
        for k in range(0, rows, AT_ONCE):
            w, y = ids[k : k + AT_ONCE], ys[k : k + AT_ONCE]
            types, inverse = np.unique(w, return_inverse=True)
            inverse = inverse.reshape(w.shape)
            length = ends[types + 1] - ends[types]
            own = np.cumsum(length) - length
            feats = numbers[np.repeat(ends[types] - own, length) + np.arange(length.sum())]
            owner = np.repeat(np.arange(len(types)), length)
            score = np.stack([np.add.reduceat(W[feats, i], own) for i in range(L)], 1)
            g_score, g_a, g_s = _gradient(score[inverse], A, start, y)
            flat = g_score.reshape(-1, L)
            g_type = np.stack([np.bincount(inverse.ravel(), flat[:, i], len(types)) for i in range(L)], 1)
            g_w = np.stack([np.bincount(feats, g_type[owner, i], BUCKETS) for i in range(L)], 1)
            hit = np.unique(feats)
            square[hit] += g_w[hit] ** 2
            W[hit] += RATE * g_w[hit] / np.sqrt(square[hit])
            sq_a += g_a**2
            A += RATE * g_a / np.sqrt(sq_a)
            sq_s += g_s**2
            start += RATE * g_s / np.sqrt(sq_s)
    return Crf(labels, W.astype(np.float32), A, start, lexicon)


def _gradient(scores, A, start, y):
    """Gradients of the mean log-likelihood of sequences (B, T): observed less expected."""
    B, T, L = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    M, s = np.exp(A), np.exp(start)
    alpha, beta = np.empty((T, B, L)), np.empty((T, B, L))
    a = s * e[:, 0]
    for t in range(T):
        if t:
            a = (a @ M) * e[:, t]
        a = a / a.sum(1, keepdims=True)
        alpha[t] = a
    b = np.ones((B, L))
    pair = np.zeros((L, L))
    for t in range(T - 1, -1, -1):
        beta[t] = b
        if t:
            inner = e[:, t] * b
            z = ((alpha[t - 1] @ M) * inner).sum(1, keepdims=True)
            pair += ((alpha[t - 1] / z).T @ inner) * M
            b = inner @ M.T
            b = b / b.sum(1, keepdims=True)
    gamma = (alpha * beta).transpose(1, 0, 2)
    gamma /= gamma.sum(2, keepdims=True)
    g = -gamma
    np.put_along_axis(g, y[:, :, None], np.take_along_axis(g, y[:, :, None], 2) + 1, 2)
    seen = np.bincount((y[:, :-1] * L + y[:, 1:]).ravel(), minlength=L * L).reshape(L, L)
    first = np.bincount(y[:, 0], minlength=L)
    return g / B, (seen - pair) / B, (first - gamma[:, 0].sum(0)) / B


def training_sample(docs: DataFrame, per_label: int = DOCS_PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, text, label) of at most per_label documents of each label, those whose ids hash lowest.

    Ids are chosen without their texts; per_label times the labels of them are broadcast.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    chosen = rows.select("id", "label").withColumn("rank", rank).where(F.col("rank") <= per_label).select("id", "label").distinct()
    return rows.join(F.broadcast(chosen), ["id", "label"], "left_semi").select("id", "text", "label")


def fit(sample: DataFrame) -> Crf:
    """The field of a bounded sample (id, text, label), trained by one task in the order of its rows' ids."""

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0] is not None, r[0], r[2], r[1]))
        yield batch({"field": pa.array([pickle.dumps(train([(text, label) for _, text, label in rows]))], pa.binary())})

    found = map_arrow(sample.repartition(1), run, "field binary").collect()
    return pickle.loads(found[0][0]) if found else train([])


def labelled(crf: Crf, some: list[str]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    words = Words(some)
    lang, score = ["und"] * len(some), [0.0] * len(some)
    if not len(words.kind) or not crf.labels:
        return lang, score
    first = np.diff(words.text, prepend=-1) > 0
    share = crf.marginals(crf.emissions(words)[words.kind], first)
    at = np.flatnonzero(first)
    sums = np.add.reduceat(share, at, axis=0)
    best = sums.argmax(1)
    part = np.minimum(1.0, sums[np.arange(len(at)), best] / sums.sum(1))
    for i, k, p in zip(words.text[at].tolist(), best.tolist(), part.tolist(), strict=True):
        lang[i], score[i] = crf.labels[k], p
    return lang, score


def identify(df: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per input row: id, lang_pred and score (0 to 1), with the columns of keep between.

    A null text, or one without any letter, is `und` with score 0; so is every text where nothing was
    learned. Repeated rows stay apart. Columns of keep may not be named lang_pred or score.
    """
    keep = keep or []
    if taken := {"lang_pred", "score"} & {id_col, *keep}:
        raise ValueError(f"names of results are taken: {sorted(taken)}")
    sent = df.sparkSession.sparkContext.broadcast(crf)

    def run(batches):
        for b in batches:
            lang, score = [], []
            run_, size = [], 0
            for t in texts(b.column(text_col)):
                run_.append(t)
                size += len(t)
                if size >= CHARS:
                    x, y = labelled(sent.value, run_)
                    lang, score, run_, size = lang + x, score + y, [], 0
            x, y = labelled(sent.value, run_) if run_ else ([], [])
            yield batch({n: b.column(n) for n in (id_col, *keep)} | {"lang_pred": pa.array(lang + x, pa.string()), "score": pa.array(score + y, pa.float64())})

    kinds = "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in (id_col, *keep))
    columns = list(dict.fromkeys([id_col, *keep, text_col]))
    return map_arrow(df.select(*columns), run, f"{kinds}lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out (not learned from), lang_pred and score, as identify() says."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    crf = fit(training_sample(docs.where(crc_mod("doc_id", 3) != 1)))
    out = identify(docs.select("doc_id", "text"), crf)
    return out.withColumn("held_out", crc_mod("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")
