"""The packing plan against its definition, on histograms."""

import random

import pytest

from spanframe.llm.packing import cut, plan


def placed_items(histogram, placed, capacity):
    """Every piece's (sequence, offset, length), ranks expanded."""
    by_length = {}
    for p in placed:
        by_length.setdefault(p[0], []).append(p)
    for length, count in histogram.items():
        own = sorted(by_length[length], key=lambda p: p[1])
        for rank in range(count):
            p = [x for x in own if x[1] <= rank][-1]
            i = rank - p[1]
            yield p[2] + i // p[3], p[4] + i % p[3] * length, length


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_gapless_and_tight(seed):
    rnd = random.Random(seed)
    capacity = 64
    histogram = {}
    for _ in range(rnd.choice([0, 1, 5, 400])):
        x = rnd.choice([rnd.randint(1, 64), rnd.randint(1, 20), 64])
        histogram[x] = histogram.get(x, 0) + rnd.choice([1, 1, 7])
    placed, n = plan(histogram, capacity)
    sequences = {}
    for s, offset, length in placed_items(histogram, placed, capacity):
        sequences.setdefault(s, []).append((offset, length))
    assert len(sequences) == n
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(x * c for x, c in histogram.items())
    assert n <= 1 + 1.12 * -(-total // capacity)


def test_cut():
    assert cut(1, 8) == [(0, 1)]
    assert cut(8, 8) == [(0, 8)]
    assert cut(9, 8) == [(0, 1), (1, 8)]
    assert cut(16, 8) == [(0, 8), (8, 8)]
