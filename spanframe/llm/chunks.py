"""Encoding with a byte-level pattern, one white-space-delimited chunk at a time.

The pattern's matches start a new match at every single space, so where a text has no two white-space
characters in a row its matches are those of its chunks ("word", " word", " word" ...), each of which
is encoded once per worker and then looked up. Other texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from spanframe.llm.common import WordCache

CACHE_ENTRIES = 400_000
_RUN = re.compile(r"\s\s")


class ChunkEncoder:
    """encode(list of strings) -> list of little-endian unsigned 32-bit id bytes; each string stands alone."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.cache = WordCache(CACHE_ENTRIES)

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if not t or _RUN.search(t) else t.split(" ") for t in texts]
        inner = set().union(*(p[1:] for p in split if p))
        self.cache.learn(inner, lambda words: self.encode([" " + w for w in words]))
        whole = [t if p is None else p[0] for t, p in zip(texts, split, strict=True)]
        heads = self.encode(whole)
        get = self.cache.__getitem__
        return [h if p is None else h + b"".join(map(get, p[1:])) for h, p in zip(heads, split, strict=True)]
