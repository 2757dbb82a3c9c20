"""64-bit hashes of word shingles, for a batch of texts at once.

Words are runs of anything but ASCII white space, with A-Z lower-cased. A word's hash is a polynomial
over pseudo-random 64-bit values of its bytes, taken from prefix sums, so that no word is handled by
itself; a shingle mixes its words' hashes in order.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
_VALUE = np.array([int.from_bytes(hashlib.sha256(b"w%d" % b).digest()[:8], "little") for b in range(256)], _U)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (a 64-bit finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 data begin and end."""
    space = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, edges: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of the words of UTF-8 data in order; edges: what word_edges() says of it, if known."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    first, last = edges or word_edges(data)
    power, inverse = _grow(len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum(_VALUE[raw] * power[: len(raw)], out=total[1:])
    return mix((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; of the whole sequence if it has fewer words; none without words."""
    w = word_hashes(text.encode())
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, _U)
    for j in range(k):
        h = mix(h + _U(j + 1)) + w[j : len(w) - k + 1 + j]
    return np.unique(mix(h ^ _U(k)))
