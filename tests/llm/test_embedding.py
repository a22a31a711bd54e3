"""op6: the Manhattan distance in one word, and grids of any number of axis groups."""

from __future__ import annotations

import random

import numpy as np
import pytest

from strokelake.llm import near_dups
from strokelake.llm.graph import components


def test_unary_words_hold_the_manhattan_distance():
    a, b = (np.random.default_rng(s).integers(0, np.iinfo(np.uint64).max, 2000, dtype=np.uint64, endpoint=True) for s in (1, 2))
    spread = np.abs(near_dups.segment_counts(a).astype(int) - near_dups.segment_counts(b).astype(int)).sum(1)
    assert (np.bitwise_count(near_dups.unary(a) ^ near_dups.unary(b)) == spread).all()
    assert (spread <= np.bitwise_count(a ^ b)).all()


def test_forest_reaches_what_is_linked():
    rng = random.Random(8)
    base = rng.getrandbits(64)
    prints = np.array(sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(300)}), np.uint64)
    left, right = near_dups.forest(prints, 4)
    assert (np.bitwise_count(prints[left] ^ prints[right]) <= 4).all()
    label = list(range(len(prints)))

    def find(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in zip(left.tolist(), right.tolist()):
        label[find(i, label)] = find(j, label)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            assert find(i, label) == find(int(j), label)


def test_more_groups_for_more_fingerprints():
    sizes = [near_dups.grid_groups(n, 4) for n in (0, 10**5, 10**6, 10**8, 10**10)]
    assert sizes[:3] == [6, 6, 6] and sizes == sorted(sizes) and sizes[-1] > 8


@pytest.mark.parametrize("groups", [6, 8])
def test_every_number_of_groups_finds_the_same(spark, groups):
    rng = random.Random(4)
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in (rng.getrandbits(64) for _ in range(20)) for _ in range(5)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = near_dups.links(spark.createDataFrame([(v,) for v in signed], "print long"), 4, groups)
    root = {r.node: r.root for r in components(edges).collect()}
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                assert root[signed[i]] == root[signed[j]]
    assert all((r.a ^ r.b) & (1 << 64) - 1 and ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in edges.collect())
