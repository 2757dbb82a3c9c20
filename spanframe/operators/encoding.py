"""Sub-word ids with character offsets, from a tokenizer's file, over Arrow batches.

A long text is encoded in slices that end before a space between two other characters, where tokenizers that
split at white space begin a new token anyway; each slice is a row, so neither a text's tokens nor the
library's own record of them are ever whole in memory. Offsets count code points of the whole text, and
leave out white space at a token's start; a token of nothing else is empty (start = end).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanframe.operators.assembly import numbered_languages
from spanframe.operators.fixtures import bounds

#: Characters of a slice, and of the slices that are encoded in one call.
SLICE, TOGETHER = 50_000, 1_000_000
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def slices(text: str, size: int = SLICE) -> Iterator[tuple[int, str]]:
    """(place, part): parts of about so many characters, all but the first beginning with a single space."""
    at = 0
    while len(text) - at > size:
        cut = _BETWEEN.search(text, at + size)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def trimmed(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts moved over white space, to the end at most."""
    space = np.fromiter((c.isspace() for c in text), bool, len(text))
    after = np.arange(len(text) + 1)
    after[:-1][space] = len(text)
    after = np.minimum.accumulate(after[::-1])[::-1]  # the next place that is no space
    return np.minimum(after[starts], ends)


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_length: int | None = None) -> DataFrame:
    """(id, slice, first, ids, starts, ends): a row for each slice of a text, first being its first token's number.

    tokenizer: the path of a tokenizer file that every worker can read. Special tokens are not added. max_length: only so many tokens of
    a text. A null or empty text has one row without tokens; ids pass through, alike or null; other columns are not read.
    """

    def run(batches):
        t = _tokenizer(tokenizer)
        for b in batches:
            rows: list[tuple] = []
            size, counts = 0, np.zeros(b.num_rows, np.int64)

            def done(rows=rows, counts=counts, b=b):
                encoded = t.encode_batch([r[3] for r in rows], add_special_tokens=False)
                out = []
                for (i, n, at, part), e in zip(rows, encoded, strict=True):
                    keep = len(e.ids) if max_length is None else max(0, min(len(e.ids), max_length - int(counts[i])))
                    if n and not keep:
                        continue
                    spans = np.array(e.offsets[:keep], np.int64).reshape(-1, 2)
                    out.append((i, n, int(counts[i]), e.ids[:keep], trimmed(part, spans[:, 0], spans[:, 1]) + at, spans[:, 1] + at))
                    counts[i] += keep
                i, n, first, ids, starts, ends = zip(*out, strict=True) if out else ((),) * 6
                listed = pa.list_(pa.int32())
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i, pa.int64())), pa.array(n, pa.int32()), pa.array(first, pa.int64()), *(pa.array([list(map(int, x)) for x in c], listed) for c in (ids, starts, ends))], names=[id_col, "slice", "first", "ids", "starts", "ends"])

            for i, text in enumerate(b.column(1).to_pylist()):
                for n, (at, part) in enumerate(slices(text or "")):
                    if n and max_length is not None and counts[i] >= max_length:
                        break
                    rows.append((i, n, at, part))
                    size += len(part)
                    if size >= TOGETHER:
                        yield done()
                        rows.clear()
                        size = 0
            if rows:
                yield done()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, slice int, first long, ids array<int>, starts array<int>, ends array<int>")


@lru_cache(maxsize=2)
def _between_spaces(path: str) -> bool:
    """Whether the tokenizer is known to begin a new token at each single space between two other characters, whatever else stands in the text."""
    told = json.loads(_tokenizer(path).to_str())
    pre = told["pre_tokenizer"] or {}
    plain = not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"])
    return plain and told["normalizer"] is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]


#: Words whose tokens a worker remembers, and that are encoded as one text.
WORDS, TOGETHER_WORDS = 300_000, 2_000


class _Words:
    """Bounds of the tokens of words, side by side, found when first asked for."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.first, self.start, self.end = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, words: list[str], path: str) -> np.ndarray:
        """The words' numbers; the tokens of number i are those from first[i] up to first[i + 1]."""
        if len(self.at) > WORDS:
            self.__init__()
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if new:
            # Those with a space in front are encoded side by side, as they stand in a text; the others by themselves.
            new.sort(key=lambda w: w[0] != " ")
            length = np.fromiter(map(len, new), np.int64, len(new))
            spaced = int(np.searchsorted(np.fromiter((w[0] != " " for w in new), bool, len(new)), True))
            groups = [*range(0, spaced, TOGETHER_WORDS), *range(spaced, len(new) + 1)]
            found = _tokenizer(path).encode_batch(["".join(new[i:j]) for i, j in pairwise(groups)], add_special_tokens=False)
            at = np.cumsum(length) - length  # in all of them, one after the other
            size = np.fromiter((len(e) for e in found), np.int64, len(found))
            spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64, 2 * int(size.sum())).reshape(-1, 2)
            spans += np.repeat(at[groups[:-1]], size)[:, None]
            own = np.searchsorted(at, spans[:, 0], "right") - 1
            n = np.bincount(own, minlength=len(new))
            spans -= at[own][:, None]
            # Starts go over white space, to the end at most: one character where there is none but a space in front.
            start = np.maximum(spans[:, 0], own < spaced)
            first = np.cumsum(n) - n
            for i in [i for i, w in enumerate(new) if _SPACE.search(w, 1)]:
                its = slice(first[i], first[i] + n[i])
                start[its] = trimmed(new[i], spans[its, 0], spans[its, 1])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(n))
            self.start, self.end = np.append(self.start, np.minimum(start, spans[:, 1])), np.append(self.end, spans[:, 1])
        return np.fromiter((self.at[w] for w in words), np.int64, len(words))


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words()


_SPACE = re.compile(r"\s")


def token_bounds(texts: pa.Array, tokenizer: str) -> tuple[np.ndarray, ...]:
    """(row, start, end) of the tokens() of texts that are not empty, in order.

    Where the tokenizer allows it, words between single spaces are encoded once in a worker and looked up; texts with
    a space at an end or beside other white space are encoded by slices.
    """
    null = texts.is_null().to_numpy(zero_copy_only=False)
    row, place, at, _ = bounds(texts)
    plain = np.zeros(len(texts), bool)
    if _between_spaces(tokenizer):
        words = pc.list_flatten(pc.split_pattern(texts, " ")).dictionary_encode()
        each, code = words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False)
        odd = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in each), bool, len(each))
        plain = ~null & (np.bincount(row, weights=odd[code], minlength=len(texts)) == 0)
    out = []
    keep = plain[row]
    if keep.any():
        row, place, at, code = row[keep], place[keep], at[keep], code[keep]
        # A word but the first has its space in front.
        asked, of = np.unique(code * 2 + (place > 0), return_inverse=True)
        known = _words(tokenizer)
        number = known.places([" " * (k & 1) + each[k >> 1] for k in asked.tolist()], tokenizer)[of]
        n = known.first[number + 1] - known.first[number]
        token = np.arange(n.sum()) + np.repeat(known.first[number] - (np.cumsum(n) - n), n)
        from_ = np.repeat(at - (place > 0), n)
        out.append((np.repeat(row, n), from_ + known.start[token], from_ + known.end[token]))
    for i in np.flatnonzero(~plain & ~null).tolist():
        text = texts[i].as_py()
        for a, part in slices(text):
            spans = np.array(_tokenizer(tokenizer).encode(part, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            out.append((np.full(len(spans), i), trimmed(part, spans[:, 0], spans[:, 1]) + a, spans[:, 1] + a))
    row, start, end = (np.concatenate([x[c] for x in out]) if out else np.zeros(0, np.int64) for c in range(3))
    some = np.flatnonzero(start < end)
    some = some[np.argsort(row[some], kind="stable")]
    return row[some], start[some], end[some]


def tokens(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token, t_start, t_end): a row a token, empty ones too."""
    each = F.posexplode(F.arrays_zip("ids", "starts", "ends")).alias("i", "t")
    return encoded.select(id_col, "first", each).select(id_col, (F.col("first") + F.col("i")).alias("pos"), F.col("t.ids").alias("token"), F.col("t.starts").cast("long").alias("t_start"), F.col("t.ends").cast("long").alias("t_end"))


def tokenized_corpus(parts: Mapping[str, DataFrame], numbers: Mapping[str, int], tokenizer: str, text_col: str = "text", max_length: int | None = None) -> DataFrame:
    """(lang_id, row, slice, first, ids, starts, ends): all parts' texts encoded in one table with the number of their language."""
    rows = numbered_languages(parts, numbers, text_col).withColumn("row", F.struct("lang_id", F.monotonically_increasing_id().alias("n")))
    return encode(rows, tokenizer, "row", text_col if text_col == "text" else "text", max_length).select("row.lang_id", F.col("row.n").alias("row"), "slice", "first", "ids", "starts", "ends")
