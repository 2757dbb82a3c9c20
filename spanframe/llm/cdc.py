"""Content-defined chunking of UTF-8 bytes with a gear rolling hash.

The hash of a position is the sum over the last 16 bytes of gear[byte] << age, modulo 2^16, computed for
all positions at once by doubling the window. A chunk ends where the leading bits of the hash are zero:
more of them below the normal size, fewer above it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np

#: Pseudo-random 16-bit numbers of the bytes, from a rule rather than a table.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:2], "little") for b in range(256)], np.uint16)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Rolling hashes (uint16) of a uint8 array; position i covers bytes i-15 to i."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if len(h) <= k:
            break
        h[k:] += h[:-k] << np.uint16(k)  # numpy buffers overlapping operands
    return h


def boundaries(data: bytes, least: int, normal: int, most: int, strict_bits: int, loose_bits: int) -> list[int]:
    """Ends of the chunks of data, the last one len(data); never inside a UTF-8 character."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = gear_hash(raw)
    begins = np.ones(n + 1, bool)
    begins[:n] = raw & 0xC0 != 0x80
    loose = np.flatnonzero((h >> np.uint16(16 - loose_bits) == 0) & begins[1:]) + 1
    strict = loose[h[loose - 1] >> np.uint16(16 - strict_bits) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    while n - at > least:
        k = bisect_left(strict, at + least)
        end = strict[k] if k < len(strict) else n
        if end > at + normal:
            k = bisect_left(loose, at + normal)
            end = min(loose[k] if k < len(loose) else n, at + most, n)
            while end < n and not begins[end]:
                end -= 1
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends
